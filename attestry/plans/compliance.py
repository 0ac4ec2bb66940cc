"""Queries over requirements, evidence and verdicts; figures are compared along an independent path in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import numbers as N
from attestry.functions import text as T
from attestry.operators import compliance as C
from attestry.operators import verify as V
from attestry.plans import world as W
from attestry.plans.world import table
from attestry.registry import register


def _requirements(spark, sf_dir):
    rows = W.clauses(spark, sf_dir)
    return rows.withColumns({"key_terms": C.key_terms(F.col("obligation_text")), "measurements": N.measurements(F.col("obligation_text"))})


def _evidence(spark, sf_dir):
    return C.score_evidence(W.submissions(spark, sf_dir), _requirements(spark, sf_dir).select("requirement_id", "key_terms"))


_JUDGED = """j AS (SELECT l_partkey AS requirement_id, l_orderkey * 10 + l_linenumber AS evidence_id, l_quantity AS drawn, p_size AS stated,
  CASE p_partkey % 3 WHEN 0 THEN l_quantity <= p_size WHEN 1 THEN l_quantity >= p_size ELSE l_quantity = p_size END AS ok FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@register("SELECT p_partkey AS requirement_id, 'length_m' AS unit, p_size::DOUBLE AS value, p_size || ' m' AS raw FROM part")
def r24_measurements(spark, sf_dir):
    rows = W.clauses(spark, sf_dir).select("requirement_id", F.explode(N.measurements(F.col("obligation_text"))).alias("m"))
    return rows.select("requirement_id", "m.unit", "m.value", "m.raw")


@register("SELECT l_orderkey * 10 + l_linenumber AS evidence_id, round(l_quantity, 6) AS metres FROM lineitem")
def r24_evidence_figures(spark, sf_dir):
    q = N.quantities(N.figures(F.col("content")))
    return W.submissions(spark, sf_dir).select("evidence_id", F.round(F.element_at(q, "length_m"), 6).alias("metres"))


@register(f"""WITH {_JUDGED} SELECT requirement_id, bool_or(ok) AS satisfied, bool_or(ok) AND NOT bool_and(ok) AS disputed FROM j GROUP BY requirement_id""")
def c10_comparisons(spark, sf_dir):
    return C.comparisons(_requirements(spark, sf_dir), _evidence(spark, sf_dir)).select("requirement_id", "satisfied", "disputed")


@register(f"""WITH {_JUDGED}, g AS (SELECT requirement_id, bool_or(ok) AS ok, bool_and(ok) AS every FROM j GROUP BY 1)
SELECT p_partkey AS requirement_id, CASE WHEN ok IS NULL THEN 'needs_evidence' WHEN ok AND NOT every THEN 'needs_evidence' WHEN ok THEN 'compliant' ELSE 'non_compliant' END AS result,
  CASE WHEN ok IS NULL THEN CASE WHEN p_partkey % 3 = 0 THEN 'high' ELSE 'medium' END WHEN ok AND NOT every THEN 'medium' WHEN ok THEN 'none' WHEN p_partkey % 3 = 0 THEN 'critical' ELSE 'high' END AS risk,
  CASE WHEN ok IS NULL THEN 0.4 WHEN ok AND NOT every THEN 0.45 WHEN ok THEN 0.88 ELSE 0.82 END AS confidence FROM part LEFT JOIN g ON requirement_id = p_partkey""")
def c11_verdicts(spark, sf_dir):
    return C.verdicts(_requirements(spark, sf_dir), _evidence(spark, sf_dir)).select("requirement_id", "result", "risk", "confidence")


_WHOLE = "1 + 1 / 1.15 + 1 / 1.3 + 1 / 1.45"
_CASES = f"""e AS (SELECT l_partkey AS id, l_partkey % 4 AS c, l_quantity::INT AS q FROM lineitem),
g AS (SELECT id, any_value(c) AS c, count(DISTINCT q) > 1 AS values_differ, bool_or(q % 2 = 0) AS even, bool_or(q % 2 = 1) AS odd FROM e GROUP BY id),
k AS (SELECT p_partkey AS requirement_id, CASE WHEN id IS NULL THEN 'none' WHEN c = 0 THEN 'meets' WHEN c = 1 THEN CASE WHEN values_differ THEN 'clash' ELSE 'meets' END
  WHEN c = 2 THEN CASE WHEN even AND odd THEN 'clash' ELSE 'meets' END WHEN even THEN 'negated' ELSE 'short' END AS k FROM part LEFT JOIN g ON id = p_partkey)"""


def _lighting(spark, sf_dir):
    """Obligations without a figure, and passages that agree, differ in a value, oppose, deny, or say too little."""
    text = F.concat(F.lit("Exit stair landing lighting shall be provided in part "), F.lit("of the house."))
    req = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("requirement_id"), text.alias("obligation_text"), F.lit("mandatory").alias("modality"))
    terms = F.array(*map(F.lit, ("exit", "landing", "lighting", "stair")))
    req = req.withColumns({"key_terms": terms, "measurements": N.measurements(F.col("obligation_text"))})
    q, c = F.col("l_quantity").cast("int"), F.col("l_partkey") % 4
    about = F.lit("Exit stair landing lighting ")
    said = (
        F.when(c == 0, F.concat(about, F.lit("was seen on site."))).when(c == 1, F.concat(about, F.lit("reads "), q.cast("string"), F.lit(" lux on site.")))
        .when(c == 2, F.concat(about, F.when(q % 2 == 0, "is prohibited here.").otherwise("is required here.")))
        .otherwise(F.when(q % 2 == 0, F.concat(about, F.lit("is omitted."))).otherwise("Exit stair."))
    )
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("requirement_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), said.alias("content")
    )
    return req, C.score_evidence(rows, req.select("requirement_id", "key_terms"))


@register(f"""WITH {_CASES} SELECT requirement_id, CASE k WHEN 'meets' THEN 'compliant' WHEN 'negated' THEN 'non_compliant' ELSE 'needs_evidence' END AS result,
  CASE k WHEN 'meets' THEN 'none' WHEN 'negated' THEN 'high' ELSE 'medium' END AS risk,
  round(CASE k WHEN 'meets' THEN 0.95 WHEN 'negated' THEN 0.72 WHEN 'clash' THEN 0.45 WHEN 'none' THEN 0.4 ELSE 0.4 + (1 + 1 / 1.45) / ({_WHOLE}) * 0.25 END::DOUBLE, 6) AS confidence,
  CASE k WHEN 'none' THEN 'exit|landing|lighting|stair' WHEN 'short' THEN 'landing|lighting' ELSE '' END AS missing FROM k""")
def c12_verdict_cascade(spark, sf_dir):
    """Verdicts where values clash, provisions oppose each other, an obligation is denied, or terms are missing."""
    told = C.verdicts(*_lighting(spark, sf_dir))
    return told.select("requirement_id", "result", "risk", F.round("confidence", 6).alias("confidence"), F.array_join("missing", "|").alias("missing"))


@register("""WITH e AS (SELECT DISTINCT l_partkey AS id, l_quantity::INT AS q, l_quantity::INT % 2 AS p FROM lineitem WHERE l_partkey % 4 = 1),
o AS (SELECT DISTINCT l_partkey AS id, l_quantity::INT % 2 AS p FROM lineitem WHERE l_partkey % 4 = 2)
SELECT a.id AS requirement_id, 'value' AS why, count(*) AS n FROM e a JOIN e b ON a.id = b.id AND a.q < b.q GROUP BY 1
UNION ALL SELECT id, 'polarity', 1 FROM o GROUP BY id HAVING count(*) = 2""")
def j14_conflicts(spark, sf_dir):
    _, evidence = _lighting(spark, sf_dir)
    found = C.passage_conflicts(evidence).filter("requirement_id % 4 IN (1, 2)")
    why = F.when(F.col("reason").startswith("Conflicting values"), "value").otherwise("polarity")
    return found.groupBy("requirement_id", why.alias("why")).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT p_partkey AS requirement_id, 'building,clear,exit,landing,stair,width' AS terms FROM part""")
def c2_key_terms(spark, sf_dir):
    return W.clauses(spark, sf_dir).select("requirement_id", F.array_join(C.key_terms(F.col("obligation_text")), ",").alias("terms"))


@register("""SELECT l_orderkey * 10 + l_linenumber AS evidence_id, round((1 / 1.15 + 1 / 1.3 + 1 / 1.45 + 1 / 1.6 + 1 / 1.75) / (1 + 1 / 1.15 + 1 / 1.3 + 1 / 1.45 + 1 / 1.6 + 1 / 1.75), 6) AS coverage FROM lineitem""")
def c9_evidence_scores(spark, sf_dir):
    return _evidence(spark, sf_dir).select("evidence_id", F.round("term_coverage", 6).alias("coverage"))


@register(f"WITH {W.FINDINGS} SELECT requirement_id, CASE WHEN result = 'compliant' AND requirement_id % 4 = 0 THEN 'needs_evidence' ELSE result END AS result, CASE WHEN result = 'compliant' AND requirement_id % 4 = 0 THEN 0.4 ELSE confidence END AS confidence FROM fnd")
def c13_downgrade(spark, sf_dir):
    f = W.findings(spark, sf_dir)
    return C.downgrade(f, f.filter("requirement_id % 4 > 0")).select("requirement_id", "result", "confidence")


@register(f"WITH {W.FINDINGS} SELECT review_id, requirement_id FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY requirement_id) AS r FROM fnd WHERE result = 'not_assessed') WHERE r <= 5")
def c14_sample_out_of_scope(spark, sf_dir):
    from attestry.operators.retrieve import top

    rows = W.findings(spark, sf_dir).filter("result = 'not_assessed'")
    return top(rows, ["review_id"], ["requirement_id"], 5).select("review_id", "requirement_id")


@register(f"""WITH {W.FINDINGS}, r AS (SELECT review_id, count(*) FILTER (WHERE result = 'compliant') AS g, count(*) FILTER (WHERE result = 'non_compliant') AS b, count(*) FILTER (WHERE result = 'needs_evidence') AS n FROM fnd GROUP BY 1)
SELECT review_id, CASE WHEN g + b + n = 0 THEN 'UNABLE TO DETERMINE' WHEN b > 0 OR n > 0 THEN CASE WHEN g > 0 THEN 'PARTIALLY COMPLIANT' WHEN b > 0 THEN 'NON-COMPLIANT' ELSE 'UNABLE TO DETERMINE' END ELSE 'COMPLIANT' END AS label FROM r""")
def c28_report_header(spark, sf_dir):
    r = C.review_rollup(W.findings(spark, sf_dir), "review_id")
    return r.select("review_id", C.status_label(F.col("decision"), F.col("qualifier")).alias("label"))


@register("""SELECT 'c' || p_brand AS query_id, count(*) AS claims_total, count(*) FILTER (WHERE p_size > 20) AS claims_supported, round(count(*) FILTER (WHERE p_size > 20) / count(*), 6) AS score FROM part WHERE p_partkey % 11 > 0 GROUP BY 1""")
def c16_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    claims = p.select(F.concat(F.lit("c"), "p_brand").alias("query_id"), F.col("p_partkey").alias("claim_id"), F.col("p_partkey").alias("citation_id"), (F.col("p_partkey") % 11 == 0).alias("from_model"))
    cited = p.select(F.col("p_partkey").alias("citation_id"), (F.col("p_size") > 20).alias("verified"))
    return C.evidence_coverage(claims, cited).withColumn("score", F.round("score", 6))


@register("""WITH r AS (SELECT p_partkey, p_size / 50.0 AS c, greatest(0, 1 - (p_partkey % 8) * 0.2) AS p FROM part)
SELECT p_partkey, round((0.3 * c + 0.2 * 0.5 + 0.28 * c + 0.1 * 0.7 + 0.07 * 0.5 + 0.05 * p) * (0.6 + 0.4 * p), 6) AS overall FROM r""")
def c17_confidence(spark, sf_dir):
    c = F.col("p_size") / 50.0
    rows = table(spark, sf_dir, "part").select("p_partkey", c.alias("coverage"), F.lit(0.5).alias("retrieval"), c.alias("verification"), F.lit(0.7).alias("authority"), F.lit(0.5).alias("recency"), (F.col("p_partkey") % 8).alias("conflicts"))
    return C.confidence(rows).select("p_partkey", F.round("overall", 6).alias("overall"))


@register(f"""WITH {W.SOURCES} SELECT source_id, round(CASE WHEN source_id % 13 = 0 THEN 0.15 ELSE CASE WHEN role = 'governing' THEN 0.7 ELSE 0.45 END + CASE WHEN list_contains(tags, 'en') THEN 0.15 ELSE 0 END
  + CASE WHEN source_id % 2 = 0 THEN 0.06 ELSE 0 END + CASE WHEN promoted THEN 0.04 ELSE 0 END END, 6) AS authority FROM src""")
def c18_authority(spark, sf_dir):
    k = F.col("source_id")
    a = C.authority(F.col("role"), k % 2 == 0, F.col("promoted"), F.col("tags"), k % 13 == 0)
    return W.sources(spark, sf_dir).select("source_id", F.round(a, 6).alias("authority"))


@register("""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'No passage in the selected sources could be verified as supporting an answer.' WHEN p_size < 30 THEN
  'Evidence coverage is ' || CAST(p_size * 2 AS INT) || '%, below the workspace minimum of 60%.' WHEN p_partkey % 2 = 0 AND p_size < 40 THEN 'The available evidence is too weak or too contradictory to support a decision.' END AS reason FROM part""")
def c19_abstention(spark, sf_dir):
    cover = F.col("p_size") / 50.0
    overall = F.when(F.col("p_size") < 40, 0.3).otherwise(0.9)
    return table(spark, sf_dir, "part").select("p_partkey", C.abstention(F.col("p_partkey") % 9, cover, F.lit(0.6), overall, F.col("p_partkey") % 2 == 0).alias("reason"))


@register(f"WITH {W.FINDINGS} SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY requirement_id) AS INT) AS ordinal, requirement_id, CASE WHEN requirement_id % 3 = 0 THEN 'replace' ELSE 'insert' END AS action FROM fnd WHERE result IN ('non_compliant', 'needs_evidence')")
def c22_change_plan(spark, sf_dir):
    f = W.findings(spark, sf_dir)
    cited = f.filter("requirement_id % 3 = 0").select("requirement_id", F.concat(F.lit("c"), F.col("requirement_id").cast("string")).alias("citation_id"), F.lit("project").alias("role"), F.lit(1).alias("rank"))
    return C.change_plan(f, cited).select("review_id", "ordinal", "requirement_id", "action")


@register("SELECT p_partkey, 'Exit stair ' || CAST(p_size * 200 AS INT) || ' cm clear, lit to 10 lux.' AS draft FROM part")
def c23_replacement(spark, sf_dir):
    text = F.concat(F.lit("Exit stair "), F.col("p_size").cast("string"), F.lit(" cm clear, lit to 10 lux."))
    return table(spark, sf_dir, "part").select("p_partkey", C.replacement_draft(text, F.lit("length_m"), F.col("p_size") * 2.0).alias("draft"))


@register("SELECT o_custkey AS plan_id, count(*) FILTER (WHERE o_orderstatus = 'O') AS proposed, count(*) FILTER (WHERE o_orderstatus = 'F') AS accepted, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN 'deciding' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'ready' ELSE 'rejected' END AS state FROM orders GROUP BY 1")
def c24_plan_state(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "proposed").when(F.col("o_orderstatus") == "F", "accepted").otherwise("rejected")
    return C.plan_state(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), status.alias("status"))).select("plan_id", "proposed", "accepted", "state")


@register("""WITH p AS (SELECT doc_id, n_chars AS old, n_chars - (doc_id % 5) * n_chars // 10 AS new, doc_id % 10 AS changes FROM documents)
SELECT doc_id, string_agg(check_, ',' ORDER BY check_) FILTER (WHERE NOT ok) AS failed FROM (SELECT doc_id, 'shrink' AS check_, CASE WHEN old > 0 THEN greatest(0, 1 - new / old) ELSE 0 END <= least(0.35, 0.05 + 0.02 * changes) AS ok FROM p
  UNION ALL SELECT doc_id, 'pages', doc_id % 6 > 0 FROM p UNION ALL SELECT doc_id, 'media', doc_id % 8 > 0 FROM p UNION ALL SELECT doc_id, 'not_empty', new > 0 FROM p) GROUP BY doc_id""")
def c25_derivative_checks(spark, sf_dir):
    k, n = F.col("doc_id"), F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select(
        k.alias("id"), n.alias("old_chars"), (n - F.floor((k % 5) * n / 10)).alias("new_chars"), (k % 10).alias("changes"), F.lit(1).alias("old_pages"),
        F.when(k % 6 > 0, 1).otherwise(0).alias("new_pages"), F.lit(0).alias("old_media"), F.when(k % 8 > 0, 0).otherwise(1).alias("new_media"),
    )
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("check"))))  # of four checks at most
    return C.derivative_checks(rows).groupBy(F.col("id").alias("doc_id")).agg(F.nullif(F.array_join(failed, ","), F.lit("")).alias("failed"))


@register("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'revised_edition' WHEN doc_id % 3 = 0 THEN 'tracked_changes' WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'ocr_rebuild' ELSE 'overlay' END ELSE 'in_place_text' END AS strategy FROM documents")
def c26_strategy(spark, sf_dir):
    k = F.col("doc_id")
    kind = F.when(k % 3 == 0, "docx").when(k % 3 == 1, "pdf").otherwise("md")
    return table(spark, sf_dir, "documents").select("doc_id", C.correction_strategy(kind, k % 2 == 0, k % 11 == 0).alias("strategy"))


@register(f"""WITH {W.SOURCES} SELECT workspace_id, count(*) AS due, count(*) FILTER (WHERE workspace_id = 2) AS held FROM src WHERE deleted_at IS NOT NULL AND last_synced_at < TIMESTAMP '2026-06-30' - INTERVAL 30 DAY GROUP BY 1""")
def c27_retention(spark, sf_dir):
    due = W.sources(spark, sf_dir).filter(F.col("deleted_at").isNotNull() & (F.col("last_synced_at") < W.as_of() - F.expr("INTERVAL 30 DAYS")))
    return due.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("due"), F.count_if(F.col("workspace_id") == 2).alias("held"))


@register("SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size::DOUBLE + 60 ELSE p_size::DOUBLE END AS height_m, CASE WHEN p_size > 40 THEN 'super_high_rise' WHEN p_size > 23 THEN 'high_rise' ELSE 'low_rise' END AS band, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS sprinklered, p_partkey % 2 = 0 AS basement FROM part")
def c5_building(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    level = F.when(n > 40, n + 60).otherwise(n).cast("string")
    text = F.concat(F.lit("Roof level +"), level, F.lit(".00 m\nlevel 99 grid. "), F.when(k % 3 == 0, "Fully sprinklered. ").when(k % 3 == 1, "Unsprinklered. ").otherwise(""), F.when(k % 2 == 0, "Basement plan.").otherwise("Plan."))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return C.building_attributes(rows, "p_partkey")


@register("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_size::DOUBLE END AS threshold, CASE WHEN p_partkey % 3 = 0 THEN 30 > p_size WHEN p_partkey % 3 = 1 THEN 30 < p_size END AS applies FROM part")
def c6_height_condition(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.concat(F.lit("Travel distance over 9 m is checked. "), F.when(k % 3 == 0, F.concat(F.lit("A building above "), n, F.lit(" m shall be staffed."))).when(k % 3 == 1, F.concat(F.lit("A structure below "), n, F.lit(" m is simple."))).otherwise("Nothing else."))
    c = C.height_condition(text)
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", F.col("c.threshold").alias("threshold"), C.applies_at_height(F.col("c"), F.lit(30.0)).alias("applies"))


@register("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'context' WHEN p_partkey % 4 = 1 THEN 'contradicts' ELSE 'supports' END AS label FROM part""")
def r22_entailment(spark, sf_dir):
    k = F.col("p_partkey") % 4
    passage = F.when(k == 0, "Something else entirely.").when(k == 1, "Doors on exit stairs shall not be locked during occupancy.").otherwise("Doors on exit stairs are locked during occupancy.")
    return table(spark, sf_dir, "part").select("p_partkey", V.entailment(F.lit("Doors on exit stairs are locked during occupancy"), passage).alias("label"))


@register("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Conflicting values for length_m: ' || p_size || ' versus 3' WHEN p_partkey % 3 = 0 THEN 'One provision requires what the other prohibits' END AS reason FROM part""")
def r23_conflicts(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    a = F.when(n % 2 == 0, F.concat(F.lit("Exit stair landing width shall be "), n.cast("string"), F.lit(" m clear"))).when(k % 3 == 0, "Exit stair landing width shall not be obstructed").otherwise("Exit stair landing width shall be kept")
    b = F.when(n % 2 == 0, "Exit stair landing width shall be 3 m clear").otherwise("Exit stair landing width shall be obstructed")
    return W.spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", V.conflict_reason(a, b).alias("reason"))


@register(f"""WITH w AS (SELECT p_partkey AS idx, p_brand, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part),
t AS (SELECT DISTINCT idx, p_brand, {W.stem_sql('t')} AS term FROM w), n AS (SELECT count(*) AS total FROM part),
df AS (SELECT term, count(*) AS df, count(DISTINCT p_brand) FILTER (WHERE term > 'm') AS n FROM t GROUP BY 1),
s AS (SELECT idx, sum(i * p) / nullif(sum(i), 0) AS v FROM (SELECT idx, greatest((ln(total) - ln(1 + df)) / ln(total), 0) AS i, least(1, ln(1 + n) / ln(26)) AS p FROM t JOIN df USING (term), n) GROUP BY 1),
r AS (SELECT p_partkey AS idx, round(coalesce(v, 0), 9) AS v FROM part LEFT JOIN s ON idx = p_partkey),
o AS (SELECT *, max(v) OVER () >= 0.4 AS any_ FROM r)
SELECT idx, round(v, 6) AS relevance FROM o WHERE NOT any_ OR v >= 0.4 ORDER BY CASE WHEN any_ THEN -v END, idx LIMIT 60""")
def c8_relevance(spark, sf_dir):
    """Parts stand for requirements; the submission has the later half of their words, each once for a brand."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), "p_brand", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("key_terms"))
    words = p.select("p_brand", F.explode("key_terms").alias("t")).select("p_brand", T.stem(F.col("t")).alias("term")).filter("term > 'm'")
    counts = words.groupBy("term").agg(F.count_distinct("p_brand").alias("n"))
    return C.relevance(p, counts).select("idx", F.round("relevance", 6).alias("relevance"))


@register("""SELECT p_partkey AS query_id, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'unable_to_determine' WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size > 20 THEN 'no' ELSE 'yes' END
  WHEN p_partkey % 3 = 1 THEN 'yes' ELSE 'no' END AS decision FROM part""")
def r29_ask_decisions(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    p = table(spark, sf_dir, "part")
    q = p.select(k.alias("query_id"), F.when(k % 5 == 0, "Which stair").otherwise("Is the stair wide enough").alias("text"))
    claims = p.filter("p_partkey % 7 > 0").select(k.alias("query_id"), F.lit(True).alias("supported"))
    rows = p.select(k.alias("query_id"), F.explode(F.array(F.lit("governing"), F.lit("project"))).alias("role"), (k % 3).alias("c"), n.alias("n"))
    text = F.when(F.col("c") > 0, "plain words").when(F.col("role") == "governing", "Width shall not exceed 20 m").otherwise(F.concat(F.lit("Width drawn "), F.col("n"), F.lit(" m")))
    cited = rows.select("query_id", "role", F.lit(True).alias("verified"), F.when(F.col("c") == 2, "contradicts").otherwise("supports").alias("entailment"), text.alias("excerpt"))
    return V.ask_decisions(q, claims, cited)


@register("""SELECT answer_id, citation_id, rank FROM (SELECT p_size AS answer_id, p_partkey AS citation_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 2 DESC,
  CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END DESC, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 6""")
def k6_decisive(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    label = F.when(k % 3 == 0, "contradicts").when(k % 3 == 1, "supports").otherwise("context")
    cited = p.select(F.col("p_size").alias("answer_id"), k.alias("citation_id"), (k % 2 == 1).alias("verified"), label.alias("entailment"), F.col("p_retailprice").alias("rerank"))
    found = p.filter("p_partkey % 5 = 0").select(k.alias("citation_id"), F.lit("non_compliant").alias("result"))
    return V.decisive_citations(cited, found, 6)


@register("""WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS term FROM part), l AS (SELECT term, CASE WHEN term < 'm' THEN 'early' ELSE 'late' END AS d FROM (SELECT DISTINCT term FROM w) WHERE length(term) > 3),
h AS (SELECT p_partkey, d, count(*) AS n FROM w JOIN l USING (term) GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY p_partkey) AS share, row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, d) AS r FROM h)
SELECT p_partkey, d AS discipline, round(share, 6) AS share FROM s WHERE share >= 0.4 OR r = 1""")
def c3_disciplines(spark, sf_dir):
    w = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lower("p_type"), " ")).alias("term"))
    lexicon = w.select("term").distinct().filter(F.length("term") > 3).select("term", F.when(F.col("term") < "m", "early").otherwise("late").alias("discipline"))
    return C.discipline_profile(w, lexicon, "p_partkey", 0.4).withColumn("share", F.round("share", 6))


@register(f"""WITH {W.CHUNKS}, t AS (SELECT unnest({W.content_sql('content')}) AS t FROM chk WHERE role = 'project') SELECT {W.stem_sql('t')} AS stem, count(*) AS n FROM t GROUP BY 1""")
def c7_vocabulary(spark, sf_dir):
    c = W.chunks(spark, sf_dir).filter("role = 'project'").select(F.explode(T.stems(F.col("content"))).alias("stem"))
    return c.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {W.FINDINGS} SELECT review_id, requirement_id, result, CASE WHEN requirement_id % 3 = 0 THEN 'c' || requirement_id ELSE 'not cited' END AS citation FROM fnd""")
def c21_evidence_rows(spark, sf_dir):
    f = W.findings(spark, sf_dir)
    cited = f.filter("requirement_id % 3 = 0").select("requirement_id", F.concat(F.lit("c"), F.col("requirement_id").cast("string")).alias("c"))
    return f.join(cited, "requirement_id", "left").select("review_id", "requirement_id", "result", F.coalesce("c", F.lit("not cited")).alias("citation"))


_TERMS = [word for words in C.LEXICON.values() for word in words.split()] + ["landing", "width", "the"]
_PICKS = ("k", "7 * k + n", "k * k", "n", "n + 60", "n + 61")


def _trade_texts(spark, sf_dir):
    """Six words of the lexicon or beside it for each part."""
    p = W.spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n")), "k")
    words = F.array(*[F.lit(w) for w in _TERMS])
    return p.select("k", "n", F.concat_ws(" ", *[F.get(words, F.expr(f"cast(({x}) % {len(_TERMS)} as int)")) for x in _PICKS]).alias("text"))


_TRADES = f"""lexicon AS (SELECT {W.stem_sql('w')} AS stem, min(d) AS trade FROM (SELECT unnest(string_split(ws, ' ')) AS w, d FROM (VALUES {", ".join(f"('{d}', '{ws}')" for d, ws in C.LEXICON.items())}) v(d, ws)) GROUP BY 1 HAVING count(DISTINCT d) = 1),
words AS (SELECT k, n, unnest([{", ".join(f"{_TERMS!r}[CAST(({x}) % {len(_TERMS)} AS INT) + 1]" for x in _PICKS)}]) AS w FROM (SELECT p_partkey AS k, p_size AS n FROM part)),
cnt AS (SELECT k, trade, count(*) AS c FROM words JOIN lexicon ON stem = {W.stem_sql('w')} GROUP BY 1, 2),
rkd AS (SELECT *, c / sum(c) OVER (PARTITION BY k) AS share, row_number() OVER (PARTITION BY k ORDER BY c DESC, trade) AS r, lead(c, 1, 0) OVER (PARTITION BY k ORDER BY c DESC, trade) AS following FROM cnt)"""


@register(f"""WITH {_TRADES}, kept AS (SELECT k, string_agg(trade, ',' ORDER BY r) AS trades FROM rkd WHERE share >= 0.15 OR r = 1 GROUP BY k)
SELECT p_partkey, coalesce(trades, 'general') AS trades FROM part LEFT JOIN kept ON k = p_partkey""")
def c3_text_disciplines(spark, sf_dir):
    return _trade_texts(spark, sf_dir).select(F.col("k").alias("p_partkey"), F.array_join(C.text_disciplines(F.col("text")), ",").alias("trades"))


@register(f"""WITH {_TRADES}, one AS (SELECT k, trade FROM rkd WHERE r = 1 AND c > following)
SELECT p_partkey, trade AS discipline, trade IS NULL OR p_size % 4 = 0 OR trade IN ('smoke_control', 'means_of_egress') AS in_scope FROM part LEFT JOIN one ON k = p_partkey""")
def c4_clause_scope(spark, sf_dir):
    submission = F.when(F.col("n") % 4 == 0, F.array(F.lit(C.GENERAL))).otherwise(F.array(F.lit("smoke_control"), F.lit("means_of_egress")))
    own = _trade_texts(spark, sf_dir).withColumn("discipline", C.clause_discipline(F.col("text")))
    return own.select(F.col("k").alias("p_partkey"), "discipline", C.in_scope(F.col("discipline"), submission).alias("in_scope"))
