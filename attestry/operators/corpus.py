"""Corpus jobs: lines, structure, chunks, embeddings, screening, ingest outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import numbers as N
from attestry.functions import text as T

# Line patterns of headings, tables, definitions and list items.
NUMBERED = r"^\s{0,6}((?:\d{1,3})(?:\.\d{1,3}){0,5})\.?\s+([A-Z(À-ɏ][^\n]{2,140})$"
NAMED = r"(?i)^\s{0,6}(chapter|section|article|annex|appendix|part|schedule|clause)\s+([0-9IVXLC]+(?:\.\d+)*|[A-Z])(?![A-Za-z0-9_])[.:\s-]*(.*)$"
BARE = r"^\s{0,6}([A-Z][A-Z0-9 &/,'()-]{4,80})\s*$"
TABLE = r"(?i)^\s*(table|figure|fig\.|exhibit|schedule)\s+[0-9A-Z]"
DEFINITION = r"^\s*[\"“]?([A-Z][\w \-/]{2,60})[\"”]?\s+(means|shall mean|is defined as|refers to)(?![A-Za-z0-9_])"
LIST_ITEM = r"(?i)^\s*(?:[-*•●▪]|\(?[a-z]\)|\(?[ivx]+\)|\d{1,2}\))\s+"


def lines_of(pages: DataFrame, key: str = "version_id") -> DataFrame:
    """(key, page_number, line_no, line, idx): lines in reading order, idx from 0 within the key."""
    split = pages.select(key, "page_number", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    order = Window.partitionBy(key).orderBy("page_number", "line_no")
    return split.withColumn("idx", F.row_number().over(order) - 1)


def heading(line: Column) -> Column:
    """(chapter, section, clause, title, level, kind) of a heading line, else null."""
    s = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    number = F.regexp_extract(s, NUMBERED, 1)
    parts = F.split(number, r"\.")
    depth = F.size(parts)
    none = F.lit(None).cast("string")

    def made(chapter, section, clause, title, level, kind) -> Column:
        return F.struct(
            chapter.alias("chapter"), section.alias("section"), clause.alias("clause"), title.alias("title"),
            level.cast("int").alias("level"), kind.alias("kind"),
        )

    numbered = made(
        F.get(parts, F.lit(0)), F.when(depth >= 2, F.array_join(F.slice(parts, 1, 2), ".")), F.when(depth >= 3, number),
        T.normal_space(F.regexp_extract(s, NUMBERED, 2)), F.least(depth, F.lit(6)),
        F.when(depth >= 3, "clause").otherwise("heading"),
    )
    word, of = F.lower(F.regexp_extract(s, NAMED, 1)), F.regexp_extract(s, NAMED, 2)
    rest = T.normal_space(F.regexp_extract(s, NAMED, 3))
    top = word.isin("chapter", "part")
    named = made(
        F.when(top, of), F.when(word.isin("section", "article"), of), F.when(word == "clause", of),
        F.rtrim(F.concat_ws(" ", F.regexp_extract(s, NAMED, 1), of, rest)), F.when(top, 1).otherwise(2), F.lit("heading"),
    )
    table = made(none, none, none, s, F.lit(3), F.lit("table"))
    bare = made(none, none, none, T.normal_space(F.regexp_extract(s, BARE, 1)), F.lit(2), F.lit("heading"))
    item = s.rlike(LIST_ITEM) & ~s.rlike(NUMBERED)
    return (
        F.when((s == "") | (F.length(s) > 200) | item, None)
        .when(s.rlike(TABLE), table)
        .when(s.rlike(NUMBERED), numbered)
        .when(s.rlike(NAMED), named)
        .when(s.rlike(BARE) & ~s.rlike("[.!?;:]$"), bare)
    )


def sections(pages: DataFrame, key: str = "version_id") -> DataFrame:
    """Sections of each document: numbering and heading path carried down, bodies joined in order."""
    lines = lines_of(pages, key).withColumn("h", heading(F.col("line")))
    order = Window.partitionBy(key).orderBy("idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def count(flag: Column) -> Column:
        return F.sum(F.when(flag, 1).otherwise(0)).over(so_far)

    lines = (
        lines.withColumn("char_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
        .withColumn("sid", count(F.col("h").isNotNull()))
        .withColumn("gc", count(F.col("h.chapter").isNotNull()))
        .withColumn("gs", count(F.col("h.chapter").isNotNull() | F.col("h.section").isNotNull()))
    )

    def last(c: Column, by: list[str]) -> Column:
        return F.last(c, ignorenulls=True).over(Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))

    def first(c: Column, by: list[str]) -> Column:
        return F.first(c, ignorenulls=True).over(Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))

    # a section or clause heading names its chapter where none is known yet
    implied = F.substring_index(F.coalesce("h.section", "h.clause"), ".", 1)
    implied_section = F.substring_index("h.clause", ".", 2)
    lines = (
        lines.withColumn("chapter", F.coalesce(last(F.col("h.chapter"), [key]), first(implied, [key])))
        .withColumn("section", F.coalesce(last(F.col("h.section"), [key, "gc"]), first(implied_section, [key, "gc"])))
        .withColumn("clause", last(F.col("h.clause"), [key, "gs"]))
    )
    for level in range(1, 7):
        mark = F.when(F.col("h.level") == level, F.struct("idx", "h.title"))
        lines = lines.withColumn(f"l{level}", F.last(mark, ignorenulls=True).over(so_far))
    path = []
    for level in range(1, 7):
        lower = [F.coalesce(F.col(f"l{n}.idx"), F.lit(-1)) for n in range(1, level)]
        above = reduce(F.greatest, lower, F.lit(-1)) if lower else F.lit(-1)
        path.append(F.when(F.col(f"l{level}.idx") > above, F.col(f"l{level}.title")))
    lines = lines.withColumn("heading_path", F.array_compact(F.array(*path)))
    body_line = F.when(F.col("h").isNull(), F.struct("idx", "line"))
    s = F.regexp_replace("line", r"^\s+|\s+$", "")
    told = F.when(F.col("h").isNull(), F.when(s.rlike(DEFINITION), "definition").when(s.rlike(LIST_ITEM), "list"))
    grouped = lines.groupBy(key, "sid").agg(
        F.min_by(F.struct("h", "chapter", "section", "clause", "heading_path", "page_number", "char_start"), "idx").alias("f"),
        F.array_sort(F.collect_list(body_line)).alias("body_lines"),
        F.min(F.when(told.isNotNull(), F.struct("idx", told.alias("kind")))).alias("told"),
    )
    body = F.regexp_replace(F.array_join("body_lines.line", "\n"), r"^\s+|\s+$", "")
    out = grouped.select(
        key, F.coalesce("f.h.level", F.lit(1)).alias("level"),
        F.coalesce("f.h.kind", "told.kind", F.lit("paragraph")).alias("kind"), F.col("f.h").isNotNull().alias("from_heading"),
        "f.chapter", "f.section", "f.clause", F.coalesce("f.h.title", F.lit("Introduction")).alias("title"),
        body.alias("body"), "f.heading_path", "f.page_number", "f.char_start", "sid",
    )
    whole = F.concat_ws(" ", "title", "body")
    return out.select(
        key, F.row_number().over(Window.partitionBy(key).orderBy("sid")).alias("ordinal"), "level", "kind", "from_heading",
        "chapter", "section", "clause", "title", "body", "heading_path", "page_number", "char_start",
        (F.col("char_start") + F.length("body")).alias("char_end"), T.modality(whole).alias("modality"),
        T.is_requirement(F.concat_ws(". ", "title", "body")).alias("is_requirement"),
        T.effective_date(F.col("body")).alias("effective_date"), T.superseded_note(F.col("body")).alias("superseded_note"),
        T.cross_references(F.col("body")).alias("cross_references"), T.exceptions(F.col("body")).alias("exceptions"),
    )


PIECE = "array<struct<text:string,paragraph:int,start:int>>"
SPAN = "array<struct<first:int,stop:int,paragraph:int,start:int>>"
STATE = f"struct<done:{SPAN},first:int,at:int,tokens:int,start:int,paragraph:int>"


def sentence_pieces(body: Column, start: Column, target: int = 320, most: int = 512, overlap: int = 1) -> Column:
    """Sentences gathered to about ``target`` tokens, each piece opening with the last sentences of the one before.

    The size is tested once, before a sentence is added, so what is carried over may exceed the
    target; a sentence over ``most`` tokens stands alone. A piece is always a run of sentences, so the
    fold carries numbers only: each sentence is measured once and each piece joined once.
    """

    def state(done, first, at, tokens, begins, paragraph) -> Column:
        numbers = {"first": first, "at": at, "tokens": tokens, "start": begins, "paragraph": paragraph}
        return F.struct(done.cast(SPAN).alias("done"), *[n.cast("int").alias(name) for name, n in numbers.items()]).cast(STATE)

    def span(first, stop, s) -> Column:
        return F.array(F.struct(first.cast("int").alias("first"), stop.cast("int").alias("stop"), s["paragraph"].alias("paragraph"), s["start"].alias("start")))

    def pieces(xs: Column) -> Column:
        def total(first, stop, of: str) -> Column:
            return F.aggregate(F.slice(xs, first + 1, stop - first), F.lit(0), lambda n, x: n + x[of])

        def flushed(s: Column) -> Column:
            carried = F.greatest(s["first"], s["at"] - overlap)
            length = total(s["first"], s["at"], "length") + s["at"] - s["first"] - 1
            done = F.concat(s["done"], span(s["first"], s["at"], s))
            return state(done, carried, s["at"], total(carried, s["at"], "tokens"), s["start"] + length, s["paragraph"] + 1)

        def add(s: Column, x: Column) -> Column:
            holds, after = s["first"] < s["at"], s["at"] + 1
            alone = T.let(
                F.when(holds, flushed(s)).otherwise(s),
                lambda out: state(F.concat(out["done"], span(s["at"], after, out)), after, after, F.lit(0), out["start"] + x["length"], out["paragraph"] + 1),
            )
            grown = T.let(
                F.when(holds & (s["tokens"] + x["tokens"] > target), flushed(s)).otherwise(s),
                lambda room: state(room["done"], room["first"], after, room["tokens"] + x["tokens"], room["start"], room["paragraph"]),
            )
            return F.when(x["tokens"] > most, alone).otherwise(grown)

        def told(d: Column) -> Column:
            text = F.array_join(F.transform(F.slice(xs, d["first"] + 1, d["stop"] - d["first"]), lambda x: x["text"]), " ")
            return F.struct(text.alias("text"), d["paragraph"].alias("paragraph"), d["start"].alias("start"))

        zero = F.lit(0)
        spans = F.aggregate(
            xs, state(F.array().cast(SPAN), zero, zero, zero, start, zero), add, lambda s: F.when(s["first"] < s["at"], flushed(s)["done"]).otherwise(s["done"])
        )
        return F.transform(spans, told).cast(PIECE)

    measured = F.transform(T.sentences(body), lambda x: F.struct(x.alias("text"), T.token_estimate(x).alias("tokens"), F.length(x).alias("length")))
    return T.let(measured, pieces)


def section_chunks(parts: DataFrame, key: str = "version_id", target: int = 320, most: int = 512, overlap: int = 1) -> DataFrame:
    """Chunks that never cross a section; tables and definitions whole; a bare heading yields its title."""
    at, plain = F.col("char_start").cast("int").alias("start"), ~F.col("kind").isin("table", "definition")

    def made(flat: Column) -> Column:
        """The pieces of a body and their contents, before they are rows: a row of its own would go through the whole body again."""
        repeats = F.lower(flat).startswith(F.lower("title"))
        prefix = F.when(F.col("from_heading") & (F.col("title") != "") & ~repeats, F.concat("title", F.lit("\n"))).otherwise("")
        one = F.array(F.struct(F.when(plain, F.lit("")).otherwise(flat).alias("text"), F.lit(0).alias("paragraph"), at)).cast(PIECE)
        pieces = F.when(~plain | (flat == ""), one).otherwise(sentence_pieces(flat, F.col("char_start"), target, most, overlap))

        def told(lead: Column) -> Column:
            content = lambda p: F.when(plain & (flat == ""), F.trim("title")).otherwise(F.trim(F.concat(lead, p["text"])))
            return F.transform(pieces, lambda p: F.struct(p["paragraph"].alias("paragraph"), p["start"].alias("start"), F.length(p["text"]).alias("length"), content(p).alias("content")))

        return T.let(prefix, told)

    numbers = F.array_distinct(F.array_compact(F.array(F.nullif(F.trim("clause"), F.lit("")), F.nullif(F.trim("section"), F.lit("")))))
    numbers = F.when(F.size(numbers) > 0, F.concat(F.array_join(numbers, " "), F.lit(" "))).otherwise("")
    line = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise(F.col("title"))
    rows = parts.select(
        key, F.col("ordinal").alias("section_ordinal"), "chapter", "section", "clause", "kind", "page_number", "heading_path",
        F.concat(numbers, line).alias("heading_text"), F.posexplode(T.let(T.normal_space(F.col("body")), made)).alias("nth", "p"),
    ).withColumn("content", F.col("p.content")).filter("content <> ''")
    return rows.select(
        key, F.row_number().over(Window.partitionBy(key).orderBy("section_ordinal", "nth")).alias("ordinal"), "content",
        "heading_text", T.token_estimate(F.col("content")).alias("token_count"), "page_number", "chapter", "section", "clause",
        "heading_path", F.col("p.paragraph").alias("paragraph_index"), F.col("p.start").alias("char_start"),
        (F.col("p.start") + F.col("p.length")).alias("char_end"), "kind", "section_ordinal",
    )


def sheet_chunks(pages: DataFrame, key: str = "version_id", rows: int = 40) -> DataFrame:
    """Blocks of so many sheet rows, the header repeated, with their cell range."""
    filled = F.filter(F.split("text", "\r?\n"), lambda r: F.trim(r) != "")
    base = pages.select(key, "page_number", filled.alias("r")).filter(F.size("r") > 0)
    blocks = base.select("*", F.explode(F.sequence(F.lit(0), F.size("r") - 1, F.lit(rows))).alias("i"))
    block = F.slice("r", F.col("i") + 1, rows)
    text = F.array_join(block, "\n")
    last = F.col("i") + F.size(block)
    cells = F.concat(
        F.lit("A"), (F.col("i") + 1).cast("string"), F.lit(":"),
        F.when(last == F.col("i") + 1, F.concat(F.lit("A"), last.cast("string"))).otherwise(F.concat(F.lit("Z"), last.cast("string"))),
    )
    return blocks.select(
        key, "page_number", F.when(F.col("i") == 0, text).otherwise(F.concat(F.get("r", F.lit(0)), F.lit("\n"), text)).alias("content"),
        cells.alias("cell_range"), F.floor(F.col("i") / rows).cast("int").alias("paragraph_index"),
    )


def slide_chunks(pages: DataFrame, key: str = "version_id") -> DataFrame:
    """One chunk for each slide with text."""
    kept = pages.filter(F.regexp_replace("text", r"\s+", "") != "")
    order = Window.partitionBy(key).orderBy("page_number")
    return kept.select(key, F.row_number().over(order).alias("ordinal"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("content"), "page_number")


def embedding_input(heading_text: Column, content: Column) -> Column:
    return F.when(F.coalesce(heading_text, F.lit("")) != "", F.concat(heading_text, F.lit("\n"), content)).otherwise(content)


def hashed_features(chunks: DataFrame, key: str = "chunk_id", text: str = "text", width: int = 768) -> DataFrame:
    """(key, bucket, weight): signed sums of hashed word, character n-gram and bigram features.

    Each distinct feature is hashed once, then joined back: n-grams repeat across documents far more
    often than they are new.
    """
    words = chunks.select(key, T.stems(F.col(text)).alias("w"))
    counts = words.select(key, F.explode("w").alias("t")).groupBy(key, "t").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    single = counts.select(key, F.concat(F.lit("t:"), "t").alias("f"), F.col("tf").alias("x"))
    grams = counts.select(key, F.explode(T.char_ngrams(F.col("t"))).alias("g"), "tf").select(
        key, F.concat(F.lit("g:"), "g").alias("f"), (F.col("tf") * 0.22).alias("x")
    )
    joined = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat(F.lit("b:"), a, F.lit("_"), b))
    pairs = words.select(key, F.explode(joined).alias("f")).filter("f IS NOT NULL").select(key, "f", F.lit(0.6).alias("x"))
    features = single.unionByName(grams).unionByName(pairs).groupBy(key, "f").agg(F.sum("x").alias("x"))
    hashed = features.select("f").distinct().select(
        "f", (N.fnv1a(F.col("f")) % width).cast("int").alias("bucket"),
        F.when(N.fnv1a(F.concat(F.lit("s:"), "f")) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"),
    )
    return features.join(hashed, "f").groupBy(key, "bucket").agg(F.sum(F.col("sign") * F.col("x")).alias("weight"))


def embeddings(chunks: DataFrame, key: str = "chunk_id", text: str = "text", width: int = 768) -> DataFrame:
    """(key, embedding): unit vectors of hashed_features(); a zero vector where there is no word."""
    sums = hashed_features(chunks, key, text, width).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"), F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm")
    )
    value = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).otherwise(0.0),
    )
    return chunks.select(key).distinct().join(sums, key, "left").select(key, value.alias("embedding"))


# Screening rules (name, category, severity, pattern).
RULES = (
    ("ignore_previous_instructions", "instruction_override", "high",
     T.words(r"(?:ignore|disregard|forget|override)\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|earlier|above|preceding|system)\s+(?:instructions?|prompts?|rules?|directions?)")),
    ("new_instructions", "instruction_override", "high", rf"(?i){T.L}(?:new|updated|revised)\s+(?:instruction|instructions|system\s+prompt|directive)s?\s*[:.]"),
    ("role_confusion", "role_confusion", "high", r"(?i)(?:^|\n[ \t]*\n[ \t]*|[.!?][ \t]*\n[ \t]*)(?:system|assistant|developer)[ \t]*[:>]"),
    ("act_as", "role_confusion", "medium", T.words(r"you\s+(?:are|must\s+now|should\s+now)\s+(?:act\s+as|behave\s+as|pretend\s+to\s+be|roleplay)")),
    ("reveal_secrets", "exfiltration", "high", rf"(?i){T.L}(?:reveal|disclose|print|output|show|repeat|dump)\s+(?:your\s+|the\s+)?(?:system\s+prompt|instructions|api\s+key|secret|credential|token|password|env(?:ironment)?\s+variable)"),
    ("exfiltrate_to_url", "exfiltration", "high", rf"(?i){T.L}(?:send|post|upload|transmit|forward|exfiltrate){T.R}[^.\n]{{0,60}}{T.L}(?:to|at)\s+https?://\S+"),
    ("disable_grounding", "tool_abuse", "high", rf"(?i){T.L}(?:disable|turn\s+off|bypass|skip|do\s+not\s+use)\s+(?:the\s+)?(?:citation|citations|grounding|knowledge\s+base|source\s+check|verification|safety)"),
    ("grant_permission", "tool_abuse", "high", rf"(?i){T.L}(?:grant|give|elevate|escalate){T.R}[^.\n]{{0,40}}{T.L}(?:admin|owner|full)\s+(?:access|permission|privilege)"),
    ("mark_compliant", "tool_abuse", "high", rf"(?i){T.L}(?:mark|report|declare|treat|consider){T.R}[^.\n]{{0,40}}{T.L}(?:as\s+)?(?:fully\s+)?compliant{T.R}[^.\n]{{0,40}}{T.L}(?:regardless|without|no\s+matter|even\s+if){T.R}"),
    ("fake_citation", "tool_abuse", "high", rf"(?i){T.L}(?:cite|reference|attribute){T.R}[^.\n]{{0,40}}{T.L}(?:any|a\s+random|a\s+made[\s-]?up|fictional|invented){T.R}[^.\n]{{0,20}}{T.L}(?:page|clause|section|source)"),
    ("delimiter_injection", "instruction_override", "medium", r"(?i)\[/?(?:INST|SYSTEM|SYS)\]|<\|(?:im_start|im_end|system|endoftext)\|>|###\s*(?:System|Instruction)\s*:"),
    ("hidden_html_instruction", "hidden_content", "medium", r"""(?i)<[^>]*style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|color\s*:\s*#?f{3,6}\b)[^"']*["'][^>]*>"""),
    ("script_or_macro", "tool_abuse", "medium", rf"(?i)<script{T.R}|javascript:|vbscript:|{T.L}(?:Auto_?Open|Workbook_Open|Document_Open){T.R}"),
)


def screen(docs: DataFrame, key: str, text: str = "text", most: int = 20) -> DataFrame:
    """(key, rule, category, severity, offset, excerpt): at most ``most`` signals a document, in rule order.

    One pass over the text per rule; the place of a match follows from the text between matches.
    """
    body = F.col(text)

    def of(nth: int, name: str, category: str, severity: str, pattern: str) -> Column:
        raw = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        gaps = F.when(F.size(raw) > 0, F.transform(F.split(body, pattern), lambda g: F.length(g)))

        def one(r: Column, i: Column) -> Column:
            offset = F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda s, n: s + n) + F.aggregate(
                F.slice(raw, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x)
            )
            return F.struct(
                F.lit(nth).alias("nth"), offset.alias("offset"), F.lit(name).alias("rule"), F.lit(category).alias("category"),
                F.lit(severity).alias("severity"), F.length(r).alias("n"),
            )

        return F.transform(raw, one)

    found = [of(nth, *rule) for nth, rule in enumerate(RULES)]
    signals = F.slice(F.concat(*found), 1, most)
    rows = docs.select(key, body.alias("body"), F.explode(signals).alias("s"))
    low = F.greatest(F.col("s.offset") - 60, F.lit(0))
    high = F.least(F.col("s.offset") + F.col("s.n") + 60, F.length("body"))
    around = F.trim(F.regexp_replace(F.substring(F.col("body"), low + 1, high - low), r"\s+", " "))
    excerpt = F.concat(F.when(low > 0, "...").otherwise(""), around, F.when(high < F.length("body"), "...").otherwise(""))
    return rows.select(key, "s.rule", "s.category", "s.severity", "s.offset", excerpt.alias("excerpt"))


# What a category says in the reason.
CATEGORY_TEXT = {
    "instruction_override": "attempts to override system instructions",
    "exfiltration": "attempts to exfiltrate secrets or data",
    "tool_abuse": "attempts to influence tools, permissions or compliance verdicts",
    "role_confusion": "attempts to impersonate a system or assistant role",
    "hidden_content": "contains hidden or invisible instruction text",
}


def screening_verdicts(docs: DataFrame, signals: DataFrame, key: str) -> DataFrame:
    """(key, high, medium, quarantined): any high signal, or two medium ones."""
    counts = signals.groupBy(key).agg(
        F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium")
    )
    out = docs.select(key).join(counts, key, "left").select(
        key, F.coalesce("high", F.lit(0)).alias("high"), F.coalesce("medium", F.lit(0)).alias("medium")
    )
    return out.withColumn("quarantined", (F.col("high") > 0) | (F.col("medium") >= 2))


def extraction_coverage(pages: DataFrame, chunks: DataFrame, key: str = "version_id") -> DataFrame:
    """(key, coverage): characters of chunks over characters of pages, at most 1, 0 without text."""
    a = pages.groupBy(key).agg(F.sum(F.length("text")).alias("p"))
    b = chunks.groupBy(key).agg(F.sum(F.length("content")).alias("c"))
    cover = F.least(F.lit(1.0), F.col("c") / F.col("p"))
    return a.join(b, key, "left").select(key, F.when(F.col("p") > 0, F.coalesce(cover, F.lit(0.0))).otherwise(0.0).alias("coverage"))


def stride_sample(rows: DataFrame, key: str, order: list[str], most: int = 20) -> DataFrame:
    """At most so many rows of each key, evenly spaced in order."""
    by = Window.partitionBy(key)
    ranked = rows.withColumn("_r", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    stride = F.greatest(F.floor(F.col("_n") / most), F.lit(1))
    kept = ranked.filter((F.col("_r") % stride == 0) & (F.col("_r") / stride < most))
    return kept.drop("_r", "_n")


def ingest_outcome(verdicts: DataFrame, maps: DataFrame, coverage: DataFrame, key: str) -> DataFrame:
    """(key, outcome): quarantined, needs_review (citation map not valid or nothing extracted) or ready."""
    joined = verdicts.join(maps, key, "left").join(coverage, key, "left")
    bad = ~F.coalesce("valid", F.lit(False)) | (F.coalesce("coverage", F.lit(0.0)) <= 0)
    return joined.select(key, F.when(F.col("quarantined"), "quarantined").when(bad, "needs_review").otherwise("ready").alias("outcome"))
