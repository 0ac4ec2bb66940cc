"""Citations: excerpts located on stored pages, highlight boxes, entailment, conflicts, claims, summaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import numbers as N
from attestry.functions import text as T
from attestry.operators.retrieve import small

# Wording that denies, obliges or forbids.
NEGATIVE_CLAIM = T.words(r"not|no|without|prohibited|shall not|must not|fails?|non-compliant")
NEGATIVE_PASSAGE = T.words(r"shall not|must not|is prohibited|are prohibited|no .{0,20}shall|not permitted|not allowed")
OBLIGING = T.words(r"shall|must|shall not|must not|required|prohibited")
FORBIDS = T.words(r"shall not|must not|is prohibited|not permitted")
REQUIRES = T.words(r"shall|must|is required")


def normalised_span(page: str, needle: str) -> tuple[int, int] | None:
    """Code points of the first place in page whose normal form equals the needle's.

    Works on a copy of the page in normal form that keeps the original place of each character.
    """
    import re

    one = dict(zip(T.FOLD_ONE[0], T.FOLD_ONE[1], strict=True)) | dict.fromkeys(T.FOLD_NONE, "") | T.FOLD_MANY
    out: list[str] = []
    at: list[int] = []
    gap, i = False, 0
    wrap = re.compile(r"(?:[ \t]*\r?\n[ \t]*|[ \t]+)(?=[^\W\d_])")
    while i < len(page):
        c = one.get(page[i], page[i])
        if c == "-" and out and out[-1].isalpha() and (m := wrap.match(page, i + 1)) and page[m.end()].islower():
            i, gap = m.end(), False
            continue
        for x in c:
            if x.isspace():
                gap = bool(out)
                continue
            if gap:
                out.append(" ")
                at.append(i)
                gap = False
            for low in x.lower():
                out.append(low)
                at.append(i)
        i += 1
    flat = "".join(one.get(c, c) for c in needle)
    flat = re.sub(r"([^\W\d_])-(?:[ \t]*\r?\n[ \t]*|[ \t]+)(?=([^\W\d_]))", lambda m: m[1] if m[2].islower() else m[0], flat)
    flat = " ".join(flat.split()).lower()
    found = "".join(out).find(flat) if flat else -1
    return None if found < 0 else (at[found], at[found + len(flat) - 1] + 1)


def verify_citations(drafts: DataFrame, pages: DataFrame) -> DataFrame:
    """Citation drafts (citation_id, version_id, page_number, excerpt) held against the claimed page.

    Adds verified, method (exact, normalized, failed), reason, char_start, char_end and matched_text.
    Exact places come from the JVM; the few excerpts that agree only in normal form go through one
    Arrow function for their offsets.
    """
    own = pages.select("version_id", "page_number", F.col("text").alias("_page"))
    rows = drafts.join(own, ["version_id", "page_number"], "left")
    needle = F.regexp_replace("excerpt", r"^\s+|\s+$", "")
    rows = rows.withColumn("_needle", needle).withColumn("_at", F.expr("locate(_needle, _page)"))
    folded = F.contains(T.normal_match(F.col("_page")), T.normal_match(F.col("_needle")))
    kind = (
        F.when(T.normal_space(F.coalesce("excerpt", F.lit(""))) == "", "empty").when(F.col("_page").isNull(), "no page")
        .when(F.col("_at") > 0, "exact").when(folded, "normalized").otherwise("absent")
    )
    rows = rows.withColumn("_kind", kind)

    places = pa.struct([("start", pa.int32()), ("stop", pa.int32())])

    @F.arrow_udf("start int, stop int")
    def spans(page: pa.Array, excerpt: pa.Array) -> pa.Array:
        # one text at a time, not the whole batch, becomes a Python string
        found = (normalised_span(p.as_py(), e.as_py()) if p.is_valid else None for p, e in zip(page, excerpt, strict=True))
        return pa.array([x and {"start": x[0], "stop": x[1]} for x in found], places)

    # one pass: only the pages of excerpts that agree in normal form alone go to Python
    soft = F.col("_kind") == "normalized"
    rows = rows.withColumn("_s", spans(F.when(soft, F.col("_page")), F.when(soft, F.col("_needle"))))
    reason = (
        F.when(F.col("_kind") == "empty", "Excerpt is empty")
        .when(F.col("_kind") == "no page", "The cited page could not be loaded from stored extracted text")
        .when(F.col("_kind") == "absent", F.concat(F.lit("Excerpt does not appear on page "), F.col("page_number").cast("string"), F.lit(" of the stored source text")))
    )
    start = F.when(soft, F.col("_s.start")).otherwise(F.col("_at") - 1)
    stop = F.when(soft, F.col("_s.stop")).otherwise(F.col("_at") - 1 + F.length("_needle"))
    good = F.col("_kind").isin("exact", "normalized") & start.isNotNull()
    return rows.select(
        *drafts.columns, good.alias("verified"), F.when(good, F.col("_kind")).otherwise("failed").alias("method"), reason.alias("reason"),
        F.when(good, start).alias("char_start"), F.when(good, stop).alias("char_end"),
        F.when(good, F.substring(F.col("_page"), start + 1, stop - start)).alias("matched_text"),
    )


RUN = 5  # words of a passage that a document must hold in a row to be a candidate


SHORT_BLOCK = 2_000  # passages of one or two words that each document is searched for at once


def passage_candidates(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, version_id): the documents that can hold a passage, every one of them.

    passages (query_id, text), documents (version_id, text). A document that holds a passage in normal
    form holds the words between its first and its last whole; the first RUN of these (the first one, if there
    are fewer) are joined by their hash. Shorter passages, which may begin and end within words, are
    looked for in every document, a block of them at a time. An empty passage is a candidate nowhere.
    """

    def words(x: str) -> Column:
        return F.split(T.normal_match(F.col(x)), " ")

    inner = passages.select("query_id", words("text").alias("w")).filter(F.size("w") > 2)
    inner = inner.select("query_id", F.slice("w", F.lit(2), F.when(F.size("w") >= RUN + 2, RUN).otherwise(1)).alias("w"))
    keys = inner.select("query_id", F.size("w").alias("n"), F.xxhash64("w").alias("run"))
    places = documents.select("version_id", words("text").alias("w")).select("version_id", "w", F.posexplode("w").alias("i", "_"))
    runs = places.select("version_id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("w", F.col("i") + 1, n)).alias("run")) for n in (1, RUN)])).alias("r"))
    found = runs.select("version_id", "r.n", "r.run").join(small(keys), ["n", "run"]).select("query_id", "version_id").distinct()
    short = passages.select("query_id", T.normal_match(F.col("text")).alias("p")).filter((F.size(F.split("p", " ")) < 3) & (F.col("p") != ""))
    blocks = -(-short.count() // SHORT_BLOCK)
    for n in range(blocks):
        block = short.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).agg(F.collect_list(F.struct("query_id", "p")).alias("ps"))
        held = documents.select("version_id", T.normal_match(F.col("text")).alias("_d")).join(F.broadcast(block), F.lit(True))
        hits = held.select("version_id", F.explode(F.filter("ps", lambda x: F.contains(F.col("_d"), x["p"]))).alias("x"))
        found = found.unionByName(hits.select("x.query_id", "version_id"))
    return found


def highlight_boxes(rows: DataFrame, boxes: str = "word_boxes", excerpt: str = "excerpt") -> DataFrame:
    """Adds ``boxes``: a rectangle for each line of the first run of words that equals the excerpt.

    The last word of the run may be longer than the excerpt's. Lines part where a word's centre is
    off the last one by more than 0.6 of its height, 0.004 at least.
    """
    target = F.filter(F.split(T.normal_match(F.col(excerpt)), " "), lambda w: w != "")
    words = F.transform(F.col(boxes), lambda w: T.normal_match(w["t"]))
    n = F.size(target)

    def fits(i: Column) -> Column:
        last = F.get(words, i + n - 1)
        head = F.slice(words, i + 1, F.greatest(n - 1, F.lit(0)))
        return (head == F.slice(target, F.lit(1), F.greatest(n - 1, F.lit(0)))) & last.startswith(F.get(target, n - 1))

    places = F.when((n > 0) & (F.size(boxes) >= n), F.sequence(F.lit(0), F.greatest(F.size(boxes) - n, F.lit(0))))
    start = F.get(F.filter(places, lambda i: F.coalesce(fits(i), F.lit(False))), F.lit(0))
    run = F.when(start.isNotNull(), F.slice(boxes, start + 1, n))
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double,c:double>>"

    def grow(lines: Column, w: Column) -> Column:
        centre = w["y"] + w["h"] / 2
        own = F.struct(w["x"].alias("x0"), w["y"].alias("y0"), (w["x"] + w["w"]).alias("x1"), (w["y"] + w["h"]).alias("y1"), centre.alias("c"))
        last = F.try_element_at(lines, F.lit(-1))
        apart = last.isNull() | (F.abs(centre - last["c"]) > F.greatest(w["h"] * 0.6, F.lit(0.004)))
        wider = F.struct(
            F.least(last["x0"], own["x0"]).alias("x0"), F.least(last["y0"], own["y0"]).alias("y0"),
            F.greatest(last["x1"], own["x1"]).alias("x1"), F.greatest(last["y1"], own["y1"]).alias("y1"), centre.alias("c"),
        )
        return F.when(apart, F.concat(lines, F.array(own)).cast(kind)).otherwise(
            F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(wider)).cast(kind)
        )

    lines = F.aggregate(run, F.array().cast(kind), grow)
    shown = F.transform(
        lines, lambda b: F.struct(N.clamp(b["x0"]).alias("x"), N.clamp(b["y0"]).alias("y"), N.clamp(b["x1"] - b["x0"]).alias("width"), N.clamp(b["y1"] - b["y0"]).alias("height"))
    )
    return rows.withColumn("boxes", F.coalesce(shown, F.array().cast("array<struct<x:double,y:double,width:double,height:double>>")))


def select_excerpt(passage: Column, query: Column, most: int = 320) -> Column:
    """The sentence that answers best, grown to neighbours up to ``most`` characters."""
    words = F.filter(F.split(T.normal_match(query), " "), lambda t: F.length(t) > 2)
    kind = "struct<lo:int,hi:int,len:int,stop:boolean>"

    def score(s: Column, asked: Column) -> Column:
        def share(terms: Column) -> Column:
            return F.size(F.filter(terms, lambda t: F.array_contains(asked, t))) / F.sqrt(F.size(terms).cast("double"))

        return T.let(F.split(T.normal_match(s), " "), share) + F.when(s.rlike(OBLIGING), 0.35).otherwise(0.0)

    def scores(asked: Column) -> Column:
        return F.transform(T.sentences(passage), lambda s, i: F.struct(score(s, asked).alias("v"), (-i).alias("n"), s.alias("s")))

    def step(a: Column, prev: Column, nxt: Column) -> Column:
        forward = nxt.isNotNull() & (prev.isNull() | (nxt["v"] >= prev["v"]))
        cost = F.length(F.when(forward, nxt["s"]).otherwise(prev["s"])) + 1
        halt = a["stop"] | (a["len"] >= most) | cost.isNull() | (a["len"] + cost > most)
        moved = F.struct(
            F.when(forward, a["lo"]).otherwise(a["lo"] - 1).alias("lo"), F.when(forward, a["hi"] + 1).otherwise(a["hi"]).alias("hi"),
            (a["len"] + cost).alias("len"), F.lit(False).alias("stop"),
        ).cast(kind)
        ended = F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"), a["len"].alias("len"), F.lit(True).alias("stop")).cast(kind)
        return F.when(halt, ended).otherwise(moved)

    def grown(scored: Column) -> Column:
        def first(best: Column) -> Column:
            one = F.length(F.get(scored, best)["s"]).cast("int")
            return F.struct(best.cast("int").alias("lo"), best.cast("int").alias("hi"), one.alias("len"), F.lit(False).alias("stop")).cast(kind)

        def grow(a: Column, _: Column) -> Column:
            prev, nxt = F.when(a["lo"] > 0, F.get(scored, a["lo"] - 1)), F.get(scored, a["hi"] + 1)
            moved = T.let(prev, lambda p: T.let(nxt, lambda n: step(a, p, n)))
            return F.when(a["stop"], a).otherwise(moved)

        span = F.aggregate(scored, T.let(-F.array_max(scored)["n"], first), grow)

        def chosen(span: Column) -> Column:
            return F.array_join(F.transform(F.slice(scored, span["lo"] + 1, span["hi"] - span["lo"] + 1), lambda x: x["s"]), " ")

        return F.when(F.size(scored) <= 0, T.truncate_words(passage, most)).otherwise(T.normal_space(T.let(span, chosen)))

    return T.let(T.let(words, scores), grown)


def entailment(claim: Column, passage: Column) -> Column:
    """context under 28 % shared terms; contradicts where only one side is negative; else supports."""
    terms = F.array_distinct(F.filter(F.split(T.normal_match(claim), " "), lambda t: F.length(t) > 3))
    body = T.normal_match(passage)
    ratio = F.when(F.size(terms) <= 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(body, t))) / F.greatest(F.size(terms), F.lit(1)))
    return F.when(ratio < 0.28, "context").when(claim.rlike(NEGATIVE_CLAIM) != passage.rlike(NEGATIVE_PASSAGE), "contradicts").otherwise("supports")


def long_terms(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(T.normal_match(x), " "), lambda t: F.length(t) > 3))


def conflict_between(a: Column, b: Column, ta: Column, tb: Column, qa: Column, qb: Column) -> Column:
    """Why two passages on one subject conflict, else null; terms and quantities given as columns."""
    def alike(ta: Column, tb: Column) -> Column:
        return F.size(F.array_intersect(ta, tb)) / F.nullif(F.least(F.size(ta), F.size(tb)), F.lit(0))

    def values(qa: Column, qb: Column) -> Column:
        return F.transform(
            F.filter(F.map_keys(qa), lambda u: F.abs(F.element_at(qa, u) - F.try_element_at(qb, u)) > 1e-9),
            lambda u: F.concat(
                F.lit("Conflicting values for "), u, F.lit(": "), F.regexp_replace(F.element_at(qa, u).cast("string"), r"\.0$", ""),
                F.lit(" versus "), F.regexp_replace(F.element_at(qb, u).cast("string"), r"\.0$", ""),
            ),
        )

    shared = T.let(ta, lambda x: T.let(tb, lambda y: alike(x, y)))
    told = T.let(qa, lambda x: T.let(qb, lambda y: values(x, y)))
    na, nb = a.rlike(FORBIDS), b.rlike(FORBIDS)
    pa, pb = a.rlike(REQUIRES) & ~na, b.rlike(REQUIRES) & ~nb
    opposed = F.when((na & pb) | (pa & nb), "One provision requires what the other prohibits")
    return F.when(F.coalesce(shared, F.lit(0.0)) >= 0.3, F.coalesce(F.get(told, F.lit(0)), opposed))


def conflict_reason(a: Column, b: Column) -> Column:
    return conflict_between(a, b, long_terms(a), long_terms(b), N.quantities(N.figures(a)), N.quantities(N.figures(b)))


def claims(picked: DataFrame, most: int = 6, least_chars: int = 40, least_score: float = 0.0, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, claim, score): the best sentence of each passage, each sentence once, at most so many.

    Rows carry query_text, content and the order in which passages were picked.
    """
    asked = F.array_distinct(T.stems(F.col("query_text")))
    rows = picked.select("query_id", key, "picked", asked.alias("_q"), F.posexplode(T.sentences(F.col("content"))).alias("_i", "s"))
    terms = T.stems(F.col("s"))
    hits = F.size(F.filter(terms, lambda t: F.array_contains("_q", t)))
    density = F.when(F.size(terms) <= 0, 0.0).otherwise(hits / F.sqrt(F.greatest(F.size(terms), F.lit(1)).cast("double")))
    scored = rows.select("query_id", key, "picked", "_i", T.normal_space(F.col("s")).alias("claim"), (density + F.when(F.col("s").rlike(OBLIGING), 0.3).otherwise(0.0)).alias("score"))
    good = scored.filter((F.length("claim") >= least_chars) & (F.col("score") > least_score))
    best = good.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", key).orderBy(F.desc("score"), "_i"))).filter("_r = 1")
    once = best.withColumn("_d", F.row_number().over(Window.partitionBy("query_id", F.lower("claim")).orderBy("picked", key))).filter("_d = 1")
    first = once.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("picked", key))).filter(F.col("_n") <= most)
    return first.select("query_id", key, "claim", "score")


def summary(passages: DataFrame, most: int = 8, by: str = "query_id") -> DataFrame:
    """(by, idx, sentence): the most central sentences of the passages (by, picked, content), in reading order.

    Sentences are dealt by ``by`` once; every later step keeps that dealing, and a sentence goes with the
    first of its terms alone.
    """
    rows = passages.select(by, "picked", F.posexplode(T.sentences(F.col("content"))).alias("_i", "s")).filter(F.length("s") >= 40)
    own = Window.partitionBy(by)
    rows = rows.withColumn("idx", F.row_number().over(own.orderBy("picked", "_i")) - 1).withColumn("n", F.count(F.lit(1)).over(own))
    terms = rows.select(by, "idx", "n", "s", F.posexplode_outer(F.array_distinct(T.stems(F.col("s")))).alias("at", "t"))
    terms = terms.withColumn("s", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("s"))).drop("at")
    often = terms.withColumn("df", F.when(F.col("t").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy(by, "t"))))
    central = often.groupBy(by, "idx", "n").agg(
        F.max("s").alias("s"), F.coalesce(F.sum("df") / (F.count("t") * F.col("n")), F.lit(0.0)).alias("central")
    )
    score = F.col("central") * 0.7 + 0.15 / (1 + F.col("idx") * 0.02) + F.when(F.col("s").rlike(T.words("shall|must|required|prohibited")), 0.15).otherwise(0.0)
    ranked = central.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "idx"))).filter(F.col("r") <= most)
    return ranked.select(by, "idx", T.normal_space(F.col("s")).alias("sentence"))


def citation_rates(citations: DataFrame) -> DataFrame:
    """One row: citations, verified, verification_rate."""
    return citations.agg(
        F.count(F.lit(1)).alias("citations"), F.count_if("verified").alias("verified"),
        F.coalesce(F.avg(F.col("verified").cast("double")), F.lit(0.0)).alias("verification_rate"),
    )


def map_valid(checked: DataFrame, key: str = "version_id", share: float = 0.8) -> DataFrame:
    """(key, valid): at least ``share`` of a version's sampled chunks were found on their page."""
    return checked.groupBy(key).agg((F.avg(F.col("verified").cast("double")) >= share).alias("valid"))




POLAR = r"(?i)^\s*(?:does|do|is|are|can|may|must|shall|should|will|has|have|did|was|were)(?![A-Za-z0-9_])"


def ask_decisions(queries: DataFrame, claims_: DataFrame, citations: DataFrame, require_verdict: bool = False) -> DataFrame:
    """(query_id, decision): yes, no, unable_to_determine, or null where no verdict is asked for.

    queries (query_id, text), claims (query_id, supported), citations (query_id, citation_id, role,
    verified, entailment, excerpt). A figure of a project passage that breaks a governing one decides
    first; figures are met on (query_id, unit).
    """
    good = citations.filter("verified")
    held = good.select("query_id", "role", "excerpt", F.explode(F.map_entries(N.quantities(N.figures(F.col("excerpt"))))).alias("m"))
    rule = held.filter("role = 'governing'").select("query_id", F.col("m.key").alias("unit"), F.col("m.value").alias("required"), F.col("excerpt").alias("rule"))
    seen = held.filter("role = 'project'").select("query_id", F.col("m.key").alias("unit"), F.col("m.value").alias("actual"))
    judged = rule.join(seen, ["query_id", "unit"]).groupBy("query_id").agg(F.bool_and(N.satisfies(F.col("rule"), F.col("required"), F.col("actual"))).alias("met"))
    counts = good.groupBy("query_id").agg(
        F.count_if(F.col("entailment") == "contradicts").alias("against"), F.count_if(F.col("entailment") == "supports").alias("for_")
    )
    some = claims_.groupBy("query_id").agg(F.bool_or("supported").alias("some"))
    rows = queries.join(judged, "query_id", "left").join(counts, "query_id", "left").join(some, "query_id", "left")
    against, for_ = F.coalesce("against", F.lit(0)), F.coalesce("for_", F.lit(0))
    asked = F.col("text").rlike(POLAR) | F.lit(require_verdict)
    decision = (
        F.when(~asked, None).when(~F.coalesce("some", F.lit(False)), "unable_to_determine").when(~F.col("met"), "no").when(against > for_, "no")
        .when(F.col("met") & (for_ > 0), "yes").when((for_ > 0) & (against == 0), "yes").otherwise("unable_to_determine")
    )
    return rows.select("query_id", decision.alias("decision"))


def decisive_citations(citations: DataFrame, findings: DataFrame, most: int) -> DataFrame:
    """(by answer) verified first, then those of open findings, contradictions before support before context, then by rerank.

    citations (answer_id, citation_id, verified, entailment, rerank), findings (citation_id, result).
    """
    open_ = findings.filter(F.col("result").isin("non_compliant", "needs_evidence")).select("citation_id").distinct().withColumn("_open", F.lit(1))
    weight = F.when(F.col("entailment") == "contradicts", 0).when(F.col("entailment") == "supports", 1).otherwise(2)
    rows = citations.join(open_, "citation_id", "left")
    order = [F.desc("verified"), F.desc(F.coalesce("_open", F.lit(0))), weight, F.desc("rerank"), "citation_id"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("answer_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= most).select("answer_id", "citation_id", "rank")
