"""Text columns: folding, sentences, tokens, stems, excerpts, locators, obligation patterns.

Offsets and lengths are code points. Regular expressions use explicit ASCII edges, since the JVM's
word edge has meant different things for non-ASCII letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike characters and what they stand for.
FOLD_ONE = ("‘’‚‛′“”„‟″‐‑‒–—―−               　",
            "'''''\"\"\"\"\"-------" + " " * 16)
FOLD_NONE = "­​‌‍﻿"
FOLD_MANY = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "..."}

# Abbreviations before which a full stop does not end a sentence.
ABBREVIATIONS = """no nos art arts sec secs cl cls fig figs tbl para paras ch chap vol ed eds pp approx min max etc eg
ie cf vs ref app annex inc ltd co mr mrs ms dr st ave e.g i.e""".split()

# Words that carry no content.
STOPWORDS = """a an and are as at be been but by for from has have in is it its of on or that the this to was were which
with will would these those such any all not no if when where then than there their they we you""".split()

# Words that a lexical query leaves out.
QUERY_STOPWORDS = """a an and are as at be been but by do does for from has have in is it its of on or that the this to
was were what when where which with will would my me we you they their there any all not if then than""".split()

L, R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"  # word edges in ASCII
B = rf"(?:{L}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){R})"  # either edge


def words(alternatives: str) -> str:
    return f"(?i){L}(?:{alternatives}){R}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often and however deep in lambdas body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """Look-alike characters to ASCII; invisible ones go."""

    def folded(x: Column) -> Column:
        out = F.translate(x, FOLD_ONE[0] + FOLD_NONE, FOLD_ONE[1])
        for mark, plain in FOLD_MANY.items():
            out = F.replace(out, F.lit(mark), F.lit(plain))
        return F.when(F.octet_length(x) == F.length(x), x).otherwise(out)  # ASCII has nothing to fold

    return let(text, folded)


def rejoin_hyphens(text: Column) -> Column:
    """A word broken by a hyphen at a line's end, in one piece again."""
    return F.regexp_replace(text, r"(\p{L})-(?:[ \t]*\r?\n[ \t]*|[ \t]+)(\p{Ll})", "$1$2")


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(rejoin_hyphens(fold(text)), r"\s+", " "))


def normal_match(text: Column) -> Column:
    """The form used for comparison alone."""
    return F.lower(normal_space(text))


_SHORT = "|".join(sorted((a.replace(".", r"\.") for a in ABBREVIATIONS), key=len, reverse=True))
SENTENCE_END = (
    rf"(?<=[.!?])(?<!(?:^|[^A-Za-z.])(?i:{_SHORT})\.)(?<!(?:^|\s)[A-Z]\.)(?:(?<!\d\.) | (?<=\d\. )(?!\d))"
)


def sentences(text: Column) -> Column:
    """Sentences, whole abbreviations, clause numbers and initials; an empty text has none."""
    flat = F.trim(F.regexp_replace(fold(text), r"\s+", " "))
    return F.filter(F.transform(F.split(flat, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Lower-case words and dotted numbers."""
    return F.regexp_extract_all(F.lower(fold(text)), F.lit(r"[a-z]+(?:'[a-z]+)?|\d+(?:\.\d+)*"), F.lit(0))


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def stem(token: Column) -> Column:
    """Light English stem; words of up to four letters stay."""
    cut = F.length(token)
    return (
        F.when((cut <= 4) | ~token.endswith("s"), token)  # every ending below ends in s
        .when(token.endswith("ies"), F.concat(F.substring(token, F.lit(1), cut - 3), F.lit("y")))
        .when(token.rlike("(?:ss|x|z|ch|sh)es$"), F.substring(token, F.lit(1), cut - 2))
        .when(token.rlike("s$") & ~token.rlike("[su]s$"), F.substring(token, F.lit(1), cut - 1))
        .otherwise(token)
    )


def stems(text: Column) -> Column:
    return F.transform(content_tokens(text), stem)


def char_ngrams(token: Column, least: int = 3, most: int = 5) -> Column:
    """n-grams of <token>, shortest first."""
    padded = F.concat(F.lit("<"), token, F.lit(">"))

    def of(n: int) -> Column:
        places = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))))
        return F.coalesce(F.transform(places, lambda i: F.substring(padded, i, F.lit(n))), F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(least, most + 1)])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""

    def share(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return F.when((F.size(x) <= 0) | (F.size(y) <= 0), 0.0).otherwise(both / F.size(F.array_union(x, y)))

    return let(a, lambda x: let(b, lambda y: share(x, y)))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(normal_space(text)) / 4).cast("int")


def truncate_words(text: Column, most: int = 320) -> Column:
    """Cut at a space past 60 % of the length, else anywhere; an ellipsis marks the cut."""
    clean = normal_space(text)
    cut = F.substring(clean, 1, most)
    whole = F.regexp_extract(cut, r"(?s)^(.*) ", 1)  # up to the last space
    short = F.when(F.length(whole) > most * 0.6, whole).otherwise(cut)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(short), F.lit("...")))


def locator_label(chapter, section, clause, sheet, cells, slide, page, heading, paragraph, fragment) -> Column:
    """'Ch. 6 · §6.4.2 · p. 214', falling back to heading path, paragraph, fragment."""

    def part(prefix: str, c: Column) -> Column:
        return F.when(c.cast("string") != "", F.concat(F.lit(prefix), c.cast("string")))

    main = F.concat_ws(
        " · ", part("Ch. ", chapter), F.coalesce(part("§", clause), part("§", section)), part("Sheet ", sheet),
        part("", cells), F.when(slide != 0, part("Slide ", slide)), part("p. ", page),
    )
    path = F.when(F.size(heading) > 0, F.array_join(heading, " › "))
    rest = F.coalesce(path, F.concat(F.lit("¶"), (paragraph + 1).cast("string")), fragment, F.lit(""))
    return F.when(main != "", main).otherwise(rest)


def named_locators(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?i){L}(?:clause|section|article|chapter|annex|table|part)\s+([0-9A-Z]+(?:\.\d+)*)"), F.lit(1))
    return F.array_distinct(found)


def bare_locators(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"{L}(\d{{1,3}}(?:\.\d{{1,3}}){{1,4}}){R}"), F.lit(1))
    return F.array_except(F.array_distinct(found), named_locators(text))


def locators(text: Column) -> Column:
    return F.array_union(named_locators(text), bare_locators(text))


def retrievable_locators(text: Column) -> Column:
    """Named ones, and bare ones of at least three parts."""
    deep = F.filter(bare_locators(text), lambda b: F.size(F.split(b, r"\.")) >= 3)
    return F.array_union(named_locators(text), deep)


def query_phrases(text: Column) -> Column:
    """Quoted phrases as space-joined lower-case words."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]{2,120})"'), F.lit(1))
    plain = F.transform(quoted, lambda q: F.array_join(F.regexp_extract_all(F.lower(q), F.lit("[a-z0-9]+"), F.lit(0)), " "))
    return F.filter(plain, lambda p: p != "")


def query_terms(text: Column) -> Column:
    """Distinct single terms outside the quoted phrases."""
    rest = F.lower(F.regexp_replace(text, '"[^"]{2,120}"', " "))
    found = F.regexp_extract_all(rest, F.lit(r"[a-z0-9]+(?:\.[a-z0-9]+)*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(QUERY_STOPWORDS)))


# What is redacted inside a string, and by what, in this order; a text without the last
# value (in lower case, where the pattern tells no case) holds no match.
REDACTIONS = (
    (rf"{B}sk-[A-Za-z0-9_-]{{16,}}{B}", "sk-[redacted]", "sk-"),
    (rf"(?i){B}Bearer\s+[A-Za-z0-9._~+/-]{{16,}}=*", "Bearer [redacted]", "bearer"),
    (rf"{B}[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{B}", "[email]", "@"),
    (rf"{B}(?:\d[ -]?){{13,19}}{B}", "[card]", ""),
    (rf"{B}eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}{B}", "[jwt]", "eyJ"),
)


def redact(text: Column, most: int = 2000) -> Column:
    def step(pattern: str, mark: str, held: str) -> Callable[[Column], Column]:
        def told(out: Column) -> Column:
            has = F.contains(F.lower(out) if pattern.startswith("(?i)") else out, F.lit(held))
            return F.when(has, F.regexp_replace(out, pattern, mark)).otherwise(out)

        return told

    out = text
    for redaction in REDACTIONS:
        out = let(out, step(*redaction))
    return let(out, lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("...[truncated]"))).otherwise(t))


# Names of secret fields, single or in pairs, and of content fields.
SECRET_WORDS = """password passwd passphrase secret token apikey authorization auth cookie credential credentials csrf xsrf
otp totp jwt signature salt nonce pin""".split()
SECRET_PAIRS = """session token, session secret, session key, api key, private key, secret key, signing key, encryption key,
access key, recovery code, backup code, verification code, reset code, auth code, otp code, password hash, token hash,
secret hash"""
SECRET_ALONE = ["hash", "key", "session"]
CONTENT_NAMES = """text content excerpt supportingExcerpt obligationText pageText body currentContent proposedContent
editedContent""".split()


def name_words(name: Column) -> Column:
    split = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(split), "[^a-z0-9]+"), lambda w: w != "")


def is_secret_name(name: Column) -> Column:
    own = name_words(name)
    pairs = [" ".join(p.split()) for p in SECRET_PAIRS.split(",")]
    after = F.slice(own, 2, 1000)
    joined = F.zip_with(own, after, lambda a, b: F.concat(a, F.lit(" "), b))
    return (
        F.arrays_overlap(own, literals(SECRET_WORDS))
        | F.coalesce(F.exists(joined, lambda j: F.coalesce(j.isin(pairs), F.lit(False))), F.lit(False))
        | ((F.size(own) == 1) & F.array_contains(literals(SECRET_ALONE), F.coalesce(F.get(own, F.lit(0)), F.lit(""))))
    )


# Patterns of obligation, exception, reference, withdrawal and effective date.
EXCEPTION = words(
    r"notwithstanding|except (?:as|where|when)|unless otherwise|save (?:as|where)|does not apply|shall not apply"
    r"|exempt(?:ion|ed)?"
)
CROSS_REFERENCE = (
    rf"(?i){L}(?:see|refer to|in accordance with|as (?:specified|defined|required) in|per|pursuant to|subject to)\s+"
    r"((?:clause|section|article|annex|table|part|chapter)?\s*[0-9A-Z]+(?:\.\d+)*)"
)
SUPERSEDED = rf"(?i){L}(?:superseded by|replaced by|withdrawn|no longer (?:in force|applicable)|repealed){R}[^.]{{0,80}}"
EFFECTIVE = (
    rf"(?i){L}(?:effective(?: (?:from|on|date))?|in force (?:from|on)|applies from|comes into (?:force|effect) on)\s*:?\s*"
    r"(\d{1,2}\s+\w+\s+\d{4}|\w+\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2})"
)
EXEMPTIVE = words(
    r"(?:shall|will|is|are|need)\s+not\s+be\s+required|(?:is|are)\s+not\s+required"
    r"|not\s+required\s+(?:in|for|at|where|when)|(?:shall|may)\s+be\s+permitted\s+to\s+be\s+(?:omitted|waived)"
    r"|(?:is|are)\s+exempt(?:ed)?|exempt(?:ion|ions)?\s+(?:from|to)"
)
PROHIBITED = words(r"shall not|must not|may not|is prohibited|are prohibited|no .{0,30}shall")
MANDATORY = words(r"shall|must|is required to|are required to|is mandatory")
RECOMMENDED = words(r"should|is recommended|are recommended|ought to")
PERMISSIVE = words(r"may|is permitted|are permitted|is allowed|can be")
OBLIGATION = words(r"shall|must|is required|are required|shall not|must not|is prohibited|are prohibited")


def cross_references(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(CROSS_REFERENCE), F.lit(1)), normal_space)
    return F.array_distinct(F.filter(found, lambda r: (r != "") & (F.length(r) <= 40)))


def exceptions(text: Column) -> Column:
    return F.filter(sentences(text), lambda s: s.rlike(EXCEPTION))


def superseded_note(text: Column) -> Column:
    return F.nullif(normal_space(F.regexp_extract(text, SUPERSEDED, 0)), F.lit(""))


def effective_date(text: Column) -> Column:
    raw = F.regexp_replace(F.regexp_extract(text, EFFECTIVE, 1), r",?\s+", " ")
    forms = ("yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy")
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in forms]).cast("date")


def modality(text: Column) -> Column:
    """exemptive before prohibited before mandatory, recommended, permissive; else null."""
    return (
        F.when(text.rlike(EXEMPTIVE), "exemptive")
        .when(text.rlike(PROHIBITED), "prohibited")
        .when(text.rlike(MANDATORY), "mandatory")
        .when(text.rlike(RECOMMENDED), "recommended")
        .when(text.rlike(PERMISSIVE), "permissive")
    )


def is_requirement(text: Column) -> Column:
    kind = F.coalesce(modality(text), F.lit(""))
    return kind.isin("mandatory", "prohibited") & (F.length(normal_space(text)) >= 40)


def obligation_text(body: Column, most: int = 2000) -> Column:
    """The sentences that carry an obligation (all, if none does); null under 25 characters."""
    every = sentences(body)
    binding = F.filter(every, lambda s: s.rlike(OBLIGATION))
    text = normal_space(F.array_join(F.when(F.size(binding) > 0, binding).otherwise(every), " "))
    return F.when(F.length(text) >= 25, F.substring(text, 1, most))


def plain_obligation(text: Column, title: Column, most: int = 110) -> Column:
    """The obligation in plain words, for a sentence of a finding."""

    def substantive(s: Column) -> Column:
        bare = F.regexp_replace(normal_space(s), r"(?i)^(?:[a-z]|[ivx]{1,4}|\d{1,2})[.)]\s*", "")
        return F.size(F.filter(F.split(bare, " "), lambda w: w.rlike(r"\p{L}{3}"))) >= 3

    first = F.get(F.filter(sentences(text), substantive), F.lit(0))
    chosen = F.coalesce(first, F.when(substantive(title), title), text)
    out = F.regexp_replace(normal_space(chosen), r"(?i)^(?:[a-z]|[ivx]{1,4}|\d{1,2})[.)]\s+", "")
    verb = rf"(?is)^(.*?)\s*{L}(?:shall|must)\s+(not\s+)?(?:be\s+)?"
    negated = F.regexp_extract(out, verb, 2) != ""
    out = F.when(negated, F.regexp_replace(out, verb, "$1 not ")).otherwise(F.regexp_replace(out, verb, "$1 "))
    out = F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), "[.;:,]+$", "")
    cut = F.substring(out, 1, most)
    whole = F.regexp_extract(cut, r"(?s)^(.*) ", 1)
    short = F.rtrim(F.when(F.length(whole) > most * 0.6, whole).otherwise(cut))
    out = F.when(F.length(out) > most, F.concat(short, F.lit("..."))).otherwise(out)
    return F.concat(F.lower(F.substring(out, 1, 1)), F.substring(out, F.lit(2), F.length(out)))


def strip_active(text: Column) -> tuple[Column, Column]:
    """The text without scripts, styles, frames, handlers, active URIs and prompt fences, and what went."""
    out, removed = text, []
    for name, pattern in ACTIVE:
        removed.append((name, F.regexp_count(out, F.lit(pattern))))
        out = F.regexp_replace(out, pattern, " ")
    told = F.array(*[F.when(n > 0, F.concat(F.lit(f"{name} x"), n.cast("string"))) for name, n in removed])
    return out, F.array_compact(told)


# Active content, in the order in which it is taken out.
ACTIVE = (
    ("script", r"(?is)<script\b[^>]*>.*?</script\s*>"),
    ("style", r"(?is)<style\b[^>]*>.*?</style\s*>"),
    ("iframe", r"(?is)<iframe\b[^>]*>.*?</iframe\s*>"),
    ("event-handler", r"""(?i)\son[a-z]+\s*=\s*("[^"]*"|'[^']*')"""),
    ("active-uri", r"""(?i)\b(?:javascript|vbscript|data):[^\s"'<>]+"""),
    ("prompt-fence", r"(?i)<\|(?:im_start|im_end|system|endoftext)\|>|\[/?(?:INST|SYSTEM|SYS)\]"),
)


def html_text(html: Column) -> Column:
    """Readable text of a page: active content out, tags to spaces, entities resolved, blank lines collapsed."""
    out, _ = strip_active(html)
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return normal_lines(out)


def normal_lines(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
