"""Requirements out of sections, evidence against them, verdicts, roll-ups, corrections."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import numbers as N
from attestry.functions import text as T
from attestry.operators.retrieve import small
from attestry.operators.verify import FORBIDS, REQUIRES, conflict_between, long_terms
from attestry.streaming.sink import saved, scratch

# Words of an obligation that name no subject.
NOISE = """shall must should may required require requires prohibited permitted allowed accordance provided specified
applicable relevant following above below section clause article annex table figure subject means include includes including
ensure ensured provide provides comply complies compliance requirement requirements less more least most minimum maximum
exceed exceeds exceeding greater lower higher than every each all any other such measured upon within per shall_not one two
three four five see top bottom side part case type kind use used using given made taken having where when while also both
either neither unless except considered accepted american british european international national general various certain
similar appropriate suitable necessary adequate sufficient""".split()

ANCHOR, COMPLIANT, PARTIAL, SHARED = 0.34, 0.62, 0.30, 2
DENIES = T.words(
    r"shall not|must not|is not provided|are not provided|not required|no .{0,25}(?:is|are) provided|is omitted|are omitted"
    r"|not installed|not applicable"
)
PROVIDES = T.words(r"shall|must|is provided|are provided|is installed")


def key_terms(text: Column, most: int = 12) -> Column:
    """Stems that name the subject, most frequent first, then by name."""
    kept = F.filter(T.content_tokens(text), lambda t: ~t.rlike(r"^[\d.]+$") & ~t.isin(NOISE))
    found = F.filter(F.transform(kept, T.stem), lambda s: ~s.isin(NOISE) & (F.length(s) >= 3))

    def counted(stems: Column) -> Column:
        return F.transform(
            F.array_distinct(stems), lambda s: F.struct((-F.size(F.filter(stems, lambda x: x == s))).alias("n"), s.alias("s"))
        )

    return F.slice(F.transform(F.array_sort(T.let(found, counted)), lambda c: c["s"]), 1, most)


def reference(chapter: Column, section: Column, clause: Column, title: Column) -> Column:
    return F.coalesce(clause, section, F.concat(F.lit("Ch. "), chapter), F.substring(title, 1, 60))


def requirement_set(sections: DataFrame, key: str = "version_id") -> tuple[DataFrame, DataFrame]:
    """(requirements, counts): the first testable obligation of each reference of a version.

    counts has, for each version, the obligations without a clause or section number (omitted) and
    those whose wording lifts a duty (exempted).
    """
    whole = F.concat_ws(" ", "title", "body")
    rows = sections.filter("is_requirement").withColumn("_polarity", T.modality(whole))
    lifted = F.col("_polarity").isin("exemptive", "permissive", "recommended")
    homeless = F.col("clause").isNull() & F.col("section").isNull()
    counts = rows.groupBy(key).agg(
        F.count_if(~lifted & homeless).alias("omitted"), F.count_if(F.coalesce(lifted, F.lit(False))).alias("exempted")
    )
    text = T.obligation_text(F.coalesce(F.nullif("body", F.lit("")), F.col("title")))
    good = rows.filter(~F.coalesce(lifted, F.lit(False)) & ~homeless & F.col("superseded_note").isNull()).withColumn("obligation_text", text)
    good = good.filter("obligation_text IS NOT NULL").withColumn("reference", reference(*map(F.col, ("chapter", "section", "clause", "title"))))
    once = Window.partitionBy(key, "reference").orderBy("ordinal")
    first = good.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    out = first.select(
        key, F.row_number().over(Window.partitionBy(key).orderBy("ordinal")).alias("ordinal"), "reference",
        F.coalesce(F.nullif(F.substring(T.normal_space(F.col("title")), 1, 200), F.lit("")), F.col("reference")).alias("title"),
        "obligation_text", "modality", "exceptions", "cross_references",
        key_terms(F.concat_ws(" ", "title", "obligation_text")).alias("key_terms"),
        N.measurements(F.col("obligation_text")).alias("measurements"),
    )
    return out, counts


def term_coverage(terms: Column, content: Column) -> Column:
    """Share of the key terms in the content, earlier terms weighing more."""

    def share(held: Column) -> Column:
        weights = F.transform(terms, lambda t, i: F.struct((1 / (1 + i * 0.15)).alias("w"), F.array_contains(held, t).alias("in")))
        total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x["w"])
        got = F.aggregate(weights, F.lit(0.0), lambda s, x: s + F.when(x["in"], x["w"]).otherwise(0.0))
        return F.when(total == 0, 0.0).otherwise(got / total)

    return T.let(T.stems(content), share)


def score_evidence(passages: DataFrame, requirements: DataFrame, rid: str = "requirement_id") -> DataFrame:
    """passages (rid, evidence_id, content, ...) with ``measurements``, ``term_coverage`` and ``held``, the key terms found.

    A passage meets the weighed key terms of its requirement, one row each, by an equi-join; it is stemmed
    once and its stems never leave its row. term_coverage() is the same for one row.
    """
    weighed = F.transform("key_terms", lambda t, i: F.struct(i.alias("i"), t.alias("term"), (1 / (1 + i * 0.15)).alias("w")))
    terms = requirements.select(rid, weighed.alias("_t")).groupBy(rid).agg(F.array_sort(F.flatten(F.collect_list("_t"))).alias("_t"))
    terms = terms.withColumn("_total", F.aggregate("_t", F.lit(0.0), lambda s, x: s + x["w"]))
    own = F.array_distinct(T.let(T.stems(F.col("content")), lambda held: F.filter("_t", lambda x: F.array_contains(held, x["term"]))))
    out = passages.join(terms, rid, "left").withColumn("_hits", F.coalesce(own, F.array().cast("array<struct<i:int,term:string,w:double>>")))
    share = F.aggregate("_hits", F.lit(0.0), lambda s, x: s + x["w"]) / F.nullif("_total", F.lit(0.0))
    return out.withColumn("measurements", N.measurements(F.col("content"))).withColumns(
        {"term_coverage": F.coalesce(share, F.lit(0.0)), "held": F.col("_hits.term")}
    ).drop("_t", "_total", "_hits")


def comparisons(requirements: DataFrame, evidence: DataFrame, rid: str = "requirement_id") -> DataFrame:
    """(rid, unit, subject, required, observed, satisfied, disputed): figures on one subject, resolved by subject.

    Figures are met on (rid, unit), then must share two context words, one of them a key term, in a
    passage that covers enough of the requirement. A subject with passing and failing figures is
    disputed; else a passing figure decides, else the first.
    """
    e = evidence.filter(F.col("term_coverage") >= ANCHOR).select(rid, "evidence_id", "term_coverage", F.col("measurements").alias("_e"))
    rows = e.join(requirements.select(rid, "obligation_text", "key_terms", "measurements"), rid)
    # outer, as Spark would else compare once more to leave out passages without any figure
    found = F.explode_outer(compared_figures(F.col("obligation_text"), F.col("key_terms"), F.col("measurements"), F.col("_e")))
    return resolved(rows.select(rid, "evidence_id", "term_coverage", found.alias("j")), rid)


def compared_figures(obligation: Column, terms: Column, required: Column, observed: Column) -> Column:
    """Array of (unit, subject, required, observed, satisfied, ri, ei): the figures of a passage that meet those of its requirement."""

    def one(r: Column, ri: Column) -> Column:
        def met(e: Column, ei: Column, shared: Column, on: Column) -> Column:
            return F.when((F.size(shared) >= SHARED) & (F.size(on) > 0), F.struct(
                r["unit"].alias("unit"), F.array_join(F.slice(on, 1, 4), "|").alias("subject"), r["value"].alias("required"), e["value"].alias("observed"),
                N.satisfies(obligation, r["value"], e["value"]).alias("satisfied"), ri.alias("ri"), ei.alias("ei"),
            ))

        def subject(e: Column, ei: Column) -> Column:
            both = F.array_intersect(r["context"], e["context"])
            return F.when(r["unit"] == e["unit"], T.let(both, lambda shared: T.let(F.array_intersect(shared, terms), lambda on: met(e, ei, shared, on))))

        return F.transform(observed, subject)

    return F.filter(F.flatten(F.transform(required, one)), lambda x: x.isNotNull())


def resolved(found: DataFrame, rid: str) -> DataFrame:
    """comparisons() of (rid, evidence_id, term_coverage, j), j being one of compared_figures()."""
    judged = found.filter("j IS NOT NULL").select(
        rid, "j.unit", "j.subject", "j.required", "j.observed", "j.satisfied",
        F.struct((-F.col("term_coverage")).alias("c"), "evidence_id", "j.ri", "j.ei").alias("place"),
    )
    first = F.struct(F.when(F.col("satisfied"), 0).otherwise(1).alias("p"), "place")
    return judged.groupBy(rid, "unit", "subject").agg(
        F.min_by("required", first).alias("required"), F.min_by("observed", first).alias("observed"),
        F.bool_or("satisfied").alias("satisfied"), (F.bool_or("satisfied") & ~F.bool_and("satisfied")).alias("disputed"),
    )


def negates(terms: Column, modality: Column, passage: Column) -> Column:
    """The passage speaks of the subject and says the opposite."""
    body = T.normal_match(passage)
    share = F.size(F.filter(terms, lambda t: F.contains(body, t))) / F.nullif(F.size(terms), F.lit(0))
    denies = passage.rlike(DENIES)
    provides = passage.rlike(PROVIDES) & ~denies
    opposite = ((modality == "mandatory") & denies) | ((modality == "prohibited") & provides)
    return F.coalesce(share >= 0.4, F.lit(False)) & opposite


def on_point(evidence: DataFrame, rid: str) -> DataFrame:
    """(rid, p, content, t, q, forbids, requires): passages that cover enough of the requirement, equal ones once; p holds their smallest id."""
    on = evidence.filter(F.col("term_coverage") >= ANCHOR)
    once = on.groupBy(rid, "content").agg(F.min("evidence_id").alias("evidence_id"))
    forbids = F.col("content").rlike(FORBIDS)
    return once.select(
        rid, F.struct("evidence_id", F.xxhash64("content").alias("h")).alias("p"), "content", long_terms(F.col("content")).alias("t"), N.quantities(N.figures(F.col("content"))).alias("q"),
        forbids.alias("forbids"), (F.col("content").rlike(REQUIRES) & ~forbids).alias("requires"),
    )


def passage_conflicts(evidence: DataFrame, rid: str = "requirement_id") -> DataFrame:
    """(rid, a, b, reason) of on-point passages of a requirement that conflict, a < b; equal passages stand once.

    Least and greatest value of each (requirement, unit), and whether a requirement has passages that
    forbid and such that require, tell which groups can hold a conflict at all. Only in these are
    passages paired, in the task that has their requirement: pairs are not shuffled.
    """
    on = saved(on_point(evidence, rid), f"{scratch(evidence.sparkSession)}/on_point")  # read four times below
    values = on.select(rid, F.explode("q").alias("unit", "value"))
    spread = values.groupBy(rid, "unit").agg((F.max("value") - F.min("value")).alias("d")).filter("d > 1e-9").select(rid)
    both = on.groupBy(rid).agg((F.bool_or("forbids") & F.bool_or("requires")).alias("both")).filter("both").select(rid)
    held = on.join(spread.unionByName(both).distinct(), rid, "left_semi")

    def side(x: str) -> DataFrame:
        return held.select(rid, *[F.col(c).alias(f"{c}{x}") for c in ("p", "content", "t", "q", "forbids", "requires")])

    differ = F.exists(F.map_keys("qa"), lambda u: F.coalesce(F.abs(F.element_at("qa", u) - F.try_element_at("qb", u)) > 1e-9, F.lit(False)))
    opposed = (F.col("forbidsa") & F.col("requiresb")) | (F.col("requiresa") & F.col("forbidsb"))
    reason = conflict_between(*map(F.col, ("contenta", "contentb", "ta", "tb", "qa", "qb")))
    met = side("a").join(side("b"), rid).filter((F.col("pa") < F.col("pb")) & (opposed | differ))
    told = met.select(rid, F.col("pa.evidence_id").alias("a"), F.col("pb.evidence_id").alias("b"), reason.alias("reason"))
    return told.filter("reason IS NOT NULL")


def verdicts(requirements: DataFrame, evidence: DataFrame, rid: str = "requirement_id") -> DataFrame:
    """(rid, result, risk, confidence, coverage, missing): the ordered cascade over each requirement's evidence."""
    asked = requirements.select(rid, "obligation_text", "key_terms", "modality", F.col("measurements").alias("_r"))
    held = F.col("held") if "held" in evidence.columns else F.array_intersect("key_terms", T.stems(F.col("content")))
    found = F.when(F.col("term_coverage") >= ANCHOR, compared_figures(F.col("obligation_text"), F.col("key_terms"), F.col("_r"), F.col("measurements")))
    # passages meet their requirements once; read four times below
    met = saved(evidence.join(asked, rid).select(
        rid, "evidence_id", "content", "term_coverage", held.alias("held"),
        negates(F.col("key_terms"), F.col("modality"), F.col("content")).alias("negated"), found.alias("found"),
    ), f"{scratch(evidence.sparkSession)}/met")
    compared = resolved(met.select(rid, "evidence_id", "term_coverage", F.explode("found").alias("j")), rid).groupBy(rid).agg(
        F.count(F.lit(1)).alias("compared"), F.bool_or("disputed").alias("disputed"), F.bool_or(~F.col("satisfied")).alias("breach"),
        F.bool_or(F.col("satisfied") & ~F.col("disputed")).alias("meets"),
    )
    gathered = met.groupBy(rid).agg(F.max("term_coverage").alias("coverage"), F.bool_or("negated").alias("negated"))
    # at most the key terms of the requirement
    covered = met.select(rid, F.explode("held").alias("term")).groupBy(rid).agg(F.collect_set("term").alias("held"))
    rows = requirements.select(rid, "key_terms", "modality", "measurements").join(gathered, rid, "left").join(covered, rid, "left").join(compared, rid, "left")
    rows = saved(rows, f"{scratch(evidence.sparkSession)}/rows")
    none = F.col("coverage").isNull()
    strict = F.when(F.col("modality") == "prohibited", "high").otherwise("medium")
    no_figure = (F.size("measurements") > 0) & (F.coalesce("compared", F.lit(0)) == 0)
    clashes = F.coalesce("clashes", F.lit(0)) > 0
    cover = F.col("coverage")
    # passages are paired only where no step before those of clashes decides
    earlier = [F.coalesce(flag, F.lit(False)) for flag in (none, F.col("disputed"), F.col("breach"), F.col("meets"), F.col("negated"), no_figure)]
    open_ = rows.filter(~reduce(or_, earlier)).select(rid).distinct()
    if open_.isEmpty():
        rows = rows.withColumn("clashes", F.lit(0))
    else:
        clash = passage_conflicts(met.join(open_, rid, "left_semi"), rid).groupBy(rid).agg(F.count(F.lit(1)).alias("clashes"))
        rows = rows.join(clash, rid, "left")
    steps = [
        (none, "needs_evidence", strict, F.lit(0.4)),
        (F.col("disputed"), "needs_evidence", F.lit("medium"), F.lit(0.45)),
        (F.col("breach"), "non_compliant", F.when(F.col("modality") == "prohibited", "critical").otherwise("high"), F.lit(0.82)),
        (F.col("meets"), "compliant", F.lit("none"), F.lit(0.88)),
        (F.col("negated"), "non_compliant", F.lit("high"), F.lit(0.72)),
        (no_figure, "needs_evidence", strict, 0.4 + cover * 0.2),
        ((cover >= COMPLIANT) & ~clashes, "compliant", F.lit("none"), F.least(F.lit(0.95), 0.55 + cover * 0.4)),
        (clashes, "needs_evidence", F.lit("medium"), F.lit(0.45)),
    ]

    def chain(nth: int, last: Column) -> Column:
        out = None
        for flag, *values in steps:
            value = values[nth] if isinstance(values[nth], Column) else F.lit(values[nth])
            out = F.when(F.coalesce(flag, F.lit(False)), value) if out is None else out.when(F.coalesce(flag, F.lit(False)), value)
        return out.otherwise(last)

    missing = F.slice(F.array_except("key_terms", F.coalesce("held", F.array().cast("array<string>"))), 1, 6)
    result = chain(0, F.lit("needs_evidence"))
    return rows.select(
        rid, result.alias("result"), chain(1, strict).alias("risk"), chain(2, 0.4 + cover * 0.25).alias("confidence"),
        F.coalesce(cover, F.lit(0.0)).alias("coverage"),
        F.when((result == "needs_evidence") & ~F.coalesce("disputed", F.lit(False)), missing).otherwise(F.array().cast("array<string>")).alias("missing"),
    )


def downgrade(findings: DataFrame, cited: DataFrame, rid: str = "requirement_id") -> DataFrame:
    """A compliant finding without a citation needs evidence, at a confidence of 0.4 at most."""
    has = cited.select(rid).distinct().withColumn("_has", F.lit(True))
    bare = (F.col("result") == "compliant") & F.col("_has").isNull()
    return findings.join(has, rid, "left").select(
        *[F.when(bare, "needs_evidence").otherwise(F.col("result")).alias("result") if c == "result"
          else F.when(bare, F.least("confidence", F.lit(0.4))).otherwise(F.col("confidence")).alias("confidence") if c == "confidence"
          else F.col(c) for c in findings.columns]
    )


def review_rollup(findings: DataFrame, by: str) -> DataFrame:
    """(by, compliant, non_compliant, needs_evidence, not_assessed, risk, decision, qualifier, score)."""
    results = ("compliant", "non_compliant", "needs_evidence", "not_assessed")
    rows = findings.groupBy(by).agg(
        *[F.count_if(F.col("result") == r).alias(r) for r in results],
        F.count_if((F.col("result") == "non_compliant") & (F.col("risk") == "critical")).alias("_critical"), F.count(F.lit(1)).alias("_n"),
    )
    bad, open_, good = F.col("non_compliant"), F.col("needs_evidence"), F.col("compliant")
    risk = (
        F.when((F.col("_critical") > 0) | (bad >= 3), "critical").when(bad > 0, "high").when(open_ >= 5, "high").when(open_ > 0, "medium").otherwise("none")
    )
    assessed = good + bad + open_
    decision = (
        F.when(assessed == 0, "unable_to_determine").when(bad > 0, "no").when((open_ > 0) & (good > 0), "no")
        .when(open_ > 0, "unable_to_determine").otherwise("yes")
    )
    qualifier = F.when((good > 0) & ((bad > 0) | (open_ > 0)), "Partially compliant")
    return rows.select(by, *results, risk.alias("risk"), decision.alias("decision"), qualifier.alias("qualifier"),
                       F.round(good / F.col("_n") * 100).cast("long").alias("score"))


def status_label(decision: Column, qualifier: Column) -> Column:
    """The banner of a review."""
    return (
        F.when(decision == "unable_to_determine", "UNABLE TO DETERMINE").when(qualifier.isNotNull(), F.upper(qualifier))
        .when(decision == "yes", "COMPLIANT").when(decision == "no", "NON-COMPLIANT").otherwise("GROUNDED ANSWER")
    )


def relevance(requirements: DataFrame, vocabulary: DataFrame, budget: int = 60, floor: float = 0.4, often: int = 25) -> DataFrame:
    """Requirements (idx, key_terms) that the submission's vocabulary (term, n) is about, in document order.

    Score is the idf-weighted presence of the key terms; a single requirement scores 0. Where none
    reaches the floor the first ``budget`` stand. Adds ``relevance``.
    """
    total = F.broadcast(requirements.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("_total")))  # one row
    terms = requirements.select("idx", F.explode(F.array_distinct(F.transform("key_terms", T.stem))).alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    log_total = F.log("_total")
    idf = F.greatest(F.coalesce(F.try_divide(log_total - F.log1p("df"), log_total), F.lit(0.0)), F.lit(0.0))
    presence = F.least(F.lit(1.0), F.log1p(F.coalesce("n", F.lit(0)).cast("double")) / F.log1p(F.lit(float(often))))
    weighed = terms.join(df, "term").join(vocabulary.select("term", "n"), "term", "left").join(total, F.lit(True)).select("idx", idf.alias("i"), presence.alias("p"))
    score = weighed.groupBy("idx").agg(F.coalesce(F.try_divide(F.sum(F.col("i") * F.col("p")), F.sum("i")), F.lit(0.0)).alias("relevance"))
    # rounded, so that the order of a sum does not part equal scores
    rows = requirements.join(score, "idx", "left").withColumn("relevance", F.round(F.coalesce("relevance", F.lit(0.0)), 9))
    some = F.broadcast(rows.agg(F.coalesce(F.max("relevance") >= floor, F.lit(False)).alias("_some")))  # one row
    held = rows.join(some, F.lit(True)).filter(~F.col("_some") | (F.col("relevance") >= floor))
    return held.orderBy(F.when(F.col("_some"), -F.col("relevance")), "idx").limit(budget).drop("_some").orderBy("idx")


# Level words, heights and building words.
LEVEL = r"(?:ffl|sfl|fgl|level|lvl|elev(?:ation)?|parapet)"
LEVEL_BEFORE = rf"(?i){T.L}(?:roof\s+)?{LEVEL}{T.R}[\s.:=]{{0,4}}([+-]?\d{{1,3}}(?:[.,]\d{{1,3}})?)\s*m?{T.R}"
LEVEL_AFTER = rf"(?i)([+-]\d{{1,3}}(?:[.,]\d{{1,3}})?)\s*m?\s*(?:{T.L}(?:roof\s+)?{LEVEL}{T.R})"
SPRINKLED = T.words(r"sprinkler(?:ed|s)?|sprinkler system|fully sprinklered")
UNSPRINKLED = T.words(r"non[- ]?sprinklered|unsprinklered|no sprinkler")
BASEMENT = T.words(r"basement|sub[- ]?basement|b\d|lower ground")
HIGH_M, SUPER_M = 23, 90
ABOVE = r"(?i)(?:greater than|more than|exceeding|above|over|taller than|higher than|at least)\s+(\d{1,3}(?:[.,]\d{1,2})?)\s*m(?![A-Za-z0-9_])"
BELOW = r"(?i)(?:less than|below|under|not exceeding|up to|not more than)\s+(\d{1,3}(?:[.,]\d{1,2})?)\s*m(?![A-Za-z0-9_])"


def building_attributes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, height_m, band, sprinklered, basement): the highest level, exactly written ones before round ones."""
    body = F.col(text)
    raw = F.concat(F.regexp_extract_all(body, F.lit(LEVEL_BEFORE), F.lit(1)), F.regexp_extract_all(body, F.lit(LEVEL_AFTER), F.lit(1)))
    levels = F.transform(raw, lambda r: F.struct(F.replace(r, F.lit(","), F.lit(".")).cast("double").alias("v"), r.rlike(r"[.,]|^[+-]").alias("p")))
    levels = F.filter(levels, lambda x: F.abs(x["v"]) <= 300)
    exact = F.filter(levels, lambda x: x["p"])
    height = F.array_max(F.transform(F.when(F.size(exact) > 0, exact).otherwise(levels), lambda x: x["v"]))
    band = F.when(height > SUPER_M, "super_high_rise").when(height > HIGH_M, "high_rise").when(height.isNotNull(), "low_rise")
    return docs.select(
        key, height.alias("height_m"), band.alias("band"),
        F.when(body.rlike(UNSPRINKLED), False).when(body.rlike(SPRINKLED), True).alias("sprinklered"), body.rlike(BASEMENT).alias("basement"),
    )


def height_condition(text: Column) -> Column:
    """(threshold, direction) that a clause sets itself, from its first sentence with one; else null."""
    about = T.words(r"building|storey|story|structure|highrise|high[- ]rise|height")
    other = T.words(r"travel|distance|width|depth|diameter|spacing|length")

    def of(s: Column) -> Column:
        up, down = F.regexp_extract(s, ABOVE, 1), F.regexp_extract(s, BELOW, 1)

        def made(x: Column, way: str) -> Column:
            return F.struct(F.replace(x, F.lit(","), F.lit(".")).cast("double").alias("threshold"), F.lit(way).alias("direction"))

        return F.when(s.rlike(about) & ~s.rlike(other), F.when(up != "", made(up, "above")).when(down != "", made(down, "below")))

    return F.get(F.filter(F.transform(T.sentences(T.normal_space(text)), of), lambda x: x.isNotNull()), F.lit(0))


def applies_at_height(condition: Column, height: Column) -> Column:
    """Null where either is unknown, which means: test the clause."""
    return F.when(condition["direction"] == "above", height > condition["threshold"]).otherwise(height < condition["threshold"])


# The trades and the words that tell them.
LEXICON = {
    "smoke_control": "smoke extract exhaust plenum damper duct ventilation pressurization makeup cfm ach vent louver atrium hoistway stair",
    "fire_detection": "detector detection alarm annunciator notification sounder strobe aspirating beam manual callpoint addressable loop",
    "fire_suppression": "sprinkler hydrant standpipe riser hose nozzle deluge preaction foam mist extinguisher pump breeching suppression agent",
    "means_of_egress": "egress exit travel corridor occupant discharge refuge handrail guard baluster tread riser door signage",
    "gas_systems": "lpg lng cylinder tank regulator odorant propane butane prdp mounded aboveground gas",
    "facade_structure": "curtainwall facade cladding glazing spandrel perimeter grp aluminium composite panel insulation membrane",
    "electrical": "busbar switchgear transformer generator ups cable conduit earthing luminaire circuit distribution",
    "civil_defence_facilities": "apparatus bedroom locker dormitory barracks watchroom appliance brigade station",
}
GENERAL = "general"


def trade_of(stem: Column) -> Column:
    """The trade to which alone a stem belongs, else null."""
    owners: dict[str, set[str]] = {}
    for trade, words in LEXICON.items():
        for word in words.split():
            owners.setdefault(word, set()).add(trade)
    pairs = [(word, next(iter(own))) for word, own in owners.items() if len(own) == 1]
    table = F.map_from_arrays(F.array(*[T.stem(F.lit(w)) for w, _ in pairs]), F.array(*[F.lit(t) for _, t in pairs]))
    return F.try_element_at(table, stem)


def trade_counts(text: Column) -> Column:
    """(n, trade) of the trades whose own words a text has, most first, ties by name."""
    named = F.filter(F.transform(T.stems(text), trade_of), lambda t: t.isNotNull())

    def each(found: Column) -> Column:
        return F.transform(F.array_distinct(found), lambda t: F.struct(F.size(F.filter(found, lambda x: x == t)).alias("n"), t.alias("trade")))

    counted = T.let(named, each)
    return F.array_sort(counted, lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).when(a["trade"] < b["trade"], -1).otherwise(1))


def text_disciplines(text: Column, least: float = 0.15) -> Column:
    """The trades that a text engages with, strongest first: shares of ``least`` or more, else the strongest, else general."""

    def chosen(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda n, c: n + c["n"])
        enough = F.filter(counts, lambda c: c["n"] >= total * F.lit(least))
        return F.transform(F.when(F.size(enough) > 0, enough).otherwise(F.slice(counts, F.lit(1), F.lit(1))), lambda c: c["trade"])

    names = F.get(F.transform(F.array(trade_counts(text)), chosen), F.lit(0))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(GENERAL)))


def clause_discipline(text: Column) -> Column:
    """The one trade that a clause names most, null where there is none or a tie."""

    def single(counts: Column) -> Column:
        first, second = F.get(counts, F.lit(0)), F.get(counts, F.lit(1))
        return F.when(second.isNull() | (first["n"] > second["n"]), first["trade"])

    return F.get(F.transform(F.array(trade_counts(text)), single), F.lit(0))


def in_scope(clause: Column, submission: Column) -> Column:
    """Whether a submission of these trades may have to answer a clause of that one; null is everybody's."""
    return clause.isNull() | (clause == GENERAL) | F.array_contains(submission, GENERAL) | F.coalesce(F.array_contains(submission, clause), F.lit(False))


def discipline_profile(tokens: DataFrame, lexicon: DataFrame, key: str, least: float = 0.15) -> DataFrame:
    """(key, discipline, share): disciplines whose exclusive terms make up enough of a document's.

    tokens (key, term), lexicon (term, discipline). Where no share is enough, the strongest; where
    there is no term at all, general.
    """
    hits = tokens.join(small(lexicon), "term").groupBy(key, "discipline").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    shares = hits.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "discipline")))
    kept = shares.filter((F.col("share") >= least) | (F.col("_r") == 1)).select(key, "discipline", "share")
    none = tokens.select(key).distinct().join(kept, key, "left_anti").select(key, F.lit("general").alias("discipline"), F.lit(0.0).alias("share"))
    return kept.unionByName(none)


def evidence_coverage(claims: DataFrame, citations: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, claims_total, claims_supported, score): claims with a verified citation.

    claims (by, claim_id, citation_id, from_model), citations (citation_id, verified).
    """
    good = citations.filter("verified").select("citation_id").distinct().withColumn("_ok", F.lit(True))
    own = claims.filter(~F.col("from_model")).join(good, "citation_id", "left").groupBy(by, "claim_id").agg(F.max("_ok").alias("ok"))
    out = own.groupBy(by).agg(F.count(F.lit(1)).alias("claims_total"), F.count_if(F.coalesce("ok", F.lit(False))).alias("claims_supported"))
    return out.withColumn("score", N.clamp(F.coalesce(F.try_divide("claims_supported", "claims_total"), F.lit(0.0))))


def confidence(rows: DataFrame) -> DataFrame:
    """Adds contradiction_penalty and overall to rows with coverage, retrieval, verification, authority, recency, conflicts."""
    penalty = N.clamp(1 - F.least(F.lit(1.0), F.col("conflicts") * 0.2))
    weighed = (
        0.3 * N.clamp(F.col("coverage")) + 0.2 * N.clamp(F.col("retrieval")) + 0.28 * N.clamp(F.col("verification"))
        + 0.1 * N.clamp(F.coalesce("authority", F.lit(0.5))) + 0.07 * F.col("recency") + 0.05 * penalty
    )
    return rows.withColumn("contradiction_penalty", penalty).withColumn("overall", N.clamp(weighed * (0.6 + 0.4 * penalty)))


def authority(role: Column, has_date: Column, promoted: Column, tags: Column, superseded: Column) -> Column:
    low = F.transform(tags, lambda t: F.lower(t))

    def any_of(*names: str) -> Column:
        return F.arrays_overlap(low, T.literals(list(names)))

    extra = (
        F.when(any_of("regulation", "law", "code", "statute"), 0.2).when(any_of("standard", "iso", "astm", "nfpa", "en"), 0.15)
        .when(any_of("policy", "playbook", "procedure"), 0.05).otherwise(0.0)
    )
    score = F.when(role == "governing", 0.7).otherwise(0.45) + extra + F.when(has_date, 0.06).otherwise(0.0) + F.when(promoted, 0.04).otherwise(0.0)
    return F.when(superseded, 0.15).otherwise(N.clamp(score))


def abstention(verified: Column, coverage: Column, minimum: Column, overall: Column, ask: Column) -> Column:
    """The reason to abstain, else null."""

    def percent(x: Column) -> Column:
        return F.floor(x * 100 + 0.5).cast("string")

    low = F.concat(
        F.lit("Evidence coverage is "), percent(coverage), F.lit("%, below the workspace minimum of "), percent(minimum), F.lit("%.")
    )
    return (
        F.when(verified == 0, "No passage in the selected sources could be verified as supporting an answer.")
        .when(coverage < minimum, low)
        .when(ask & (overall < 0.35), "The available evidence is too weak or too contradictory to support a decision.")
    )


def change_plan(findings: DataFrame, citations: DataFrame) -> DataFrame:
    """(review_id, ordinal, requirement_id, action, anchor): one change for each actionable finding.

    citations (requirement_id, citation_id, role, rank); the anchor is the first project citation.
    """
    anchor = citations.filter("role = 'project'").groupBy("requirement_id").agg(F.min_by("citation_id", F.struct("rank", "citation_id")).alias("anchor"))
    rows = findings.filter(F.col("result").isin("non_compliant", "needs_evidence")).join(anchor, "requirement_id", "left")
    order = Window.partitionBy("review_id").orderBy("requirement_id")
    action = F.when(F.col("anchor").isNull(), "insert").otherwise("replace")
    return rows.select("review_id", F.row_number().over(order).alias("ordinal"), "requirement_id", action.alias("action"), "anchor")


def replacement_draft(text: Column, unit: Column, required: Column) -> Column:
    """The text with each figure of the unit's family rewritten to the required value, in the unit as written."""
    pattern = f"(?i){N.QUANTITY}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)

    def rewritten(r: Column) -> Column:
        mark = F.translate(F.regexp_extract(r, pattern, 3), "²³", "23")
        own = F.lower(F.concat(F.regexp_extract(r, pattern, 2), mark))
        value = required / N.to_family_unit(F.lit(1.0), own)
        number = F.regexp_replace(F.format_string("%.4f", value), r"\.?0+$", "")
        return F.when(N.unit_family(own) == unit, F.concat(number, F.regexp_replace(r, r"^\d+(?:[.,]\d+)?", ""))).otherwise(r)

    parts = F.zip_with(between, F.transform(found, rewritten), lambda b, r: F.concat(F.coalesce(b, F.lit("")), F.coalesce(r, F.lit(""))))
    return F.array_join(parts, "")


def correction_strategy(kind: Column, scanned: Column, encrypted: Column) -> Column:
    return (
        F.when(encrypted, "revised_edition").when(kind == "docx", "tracked_changes").when((kind == "pdf") & scanned, "ocr_rebuild")
        .when(kind == "pdf", "overlay").when(kind.isin("md", "txt", "html"), "in_place_text").otherwise("revised_edition")
    )


def plan_state(changes: DataFrame, by: str = "plan_id") -> DataFrame:
    """(by, proposed, accepted, rejected, edited, state)."""
    kinds = ("proposed", "accepted", "rejected", "edited")
    rows = changes.groupBy(by).agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    done = F.col("accepted") + F.col("edited")
    return rows.withColumn("state", F.when(F.col("proposed") > 0, "deciding").when(done > 0, "ready").otherwise("rejected"))


def derivative_checks(pairs: DataFrame) -> DataFrame:
    """(id, check, ok) of a generated file against its original: pages, media, size, shrink.

    A file may shrink by 5 % and 2 % for each change, 35 % at most.
    """
    shrink = F.greatest(F.lit(0.0), 1 - F.col("new_chars") / F.nullif(F.col("old_chars"), F.lit(0)))
    allowed = F.least(F.lit(0.35), 0.05 + 0.02 * F.col("changes"))
    checks = F.array(
        F.struct(F.lit("pages").alias("check"), (F.col("new_pages") >= F.col("old_pages")).alias("ok")),
        F.struct(F.lit("media").alias("check"), (F.col("new_media") == F.col("old_media")).alias("ok")),
        F.struct(F.lit("not_empty").alias("check"), (F.col("new_chars") > 0).alias("ok")),
        F.struct(F.lit("shrink").alias("check"), (F.coalesce(shrink, F.lit(0.0)) <= allowed).alias("ok")),
    )
    return pairs.select("id", F.inline(checks))
