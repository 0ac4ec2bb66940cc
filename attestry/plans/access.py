"""Queries over visibility, predicates, joins and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import access as A
from attestry.operators import metrics as M
from attestry.plans import world as W
from attestry.plans.world import table
from attestry.registry import register


def _people(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    users = c.select(k.alias("user_id"), (k % 4).alias("workspace_id"), F.when(k % 50 == 0, "admin").otherwise("member").alias("role"))
    groups = c.select(k.alias("user_id"), F.col("c_nationkey").cast("long").alias("group_id"))
    s = W.sources(spark, sf_dir)
    k = F.col("source_id")
    grants = s.select("source_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select(
        "source_id", F.when(F.col("n") == 1, "group").when(k % 9 == 0, "workspace").otherwise("users").alias("scope"),
        F.when(F.col("n") == 1, k % 25).alias("group_id"), F.when((F.col("n") == 0) & (k % 9 > 0), k % 300 + 1).alias("user_id"),
    ).filter("NOT (scope = 'group' AND source_id % 2 = 0)")
    return users, groups, s, grants


_WORLD = f"""WITH {W.SOURCES}, usr AS (SELECT c_custkey AS user_id, c_custkey % 4 AS workspace_id, CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'member' END AS role, c_nationkey AS grp FROM customer),
gr AS (SELECT source_id, 'group' AS scope, source_id % 25 AS group_id, NULL AS user_id FROM src WHERE source_id % 2 = 1
  UNION ALL SELECT source_id, CASE WHEN source_id % 9 = 0 THEN 'workspace' ELSE 'users' END, NULL, CASE WHEN source_id % 9 > 0 THEN source_id % 300 + 1 END FROM src),
vis AS (SELECT u.user_id, s.source_id FROM usr u JOIN src s ON s.workspace_id = u.workspace_id AND s.deleted_at IS NULL
  WHERE u.role = 'admin' OR s.owner_user_id = u.user_id OR s.access_scope = 'workspace' OR EXISTS (SELECT 1 FROM gr g WHERE g.source_id = s.source_id
    AND (g.scope = 'workspace' OR (g.scope = 'users' AND g.user_id = u.user_id) OR (g.scope = 'group' AND g.group_id = u.grp))))"""


def _visible(spark, sf_dir):
    users, groups, s, grants = _people(spark, sf_dir)
    return A.visible_sources(s, grants, users, groups)


@register(f"{_WORLD} SELECT user_id, source_id FROM vis")
def j2_visible_sources(spark, sf_dir):
    return _visible(spark, sf_dir)


@register(f"{_WORLD} SELECT user_id, count(*) AS n FROM vis GROUP BY user_id")
def j8_visible_counts(spark, sf_dir):
    users, groups, s, grants = _people(spark, sf_dir)
    return A.visible_counts(s, grants, users, groups)


def _among(spark, sf_dir, asked):
    users, groups, s, grants = _people(spark, sf_dir)
    return A.visible_among(asked, s, grants, users, groups)


@register("""SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM customer u WHERE u.c_custkey = c.conv_id * 3 AND u.c_acctbal > 0)""")
def j3_participants(spark, sf_dir):
    seen = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select((F.col("c_custkey") / 3).alias("conv_id"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn").join(seen, "conv_id", "left_semi")


@register(f"{_WORLD} SELECT source_id FROM src WHERE NOT EXISTS (SELECT 1 FROM gr WHERE gr.source_id = src.source_id AND gr.scope <> 'users')")
def j4_without_grants(spark, sf_dir):
    _, _, s, grants = _people(spark, sf_dir)
    return A.without_grants(s, grants.filter("scope <> 'users'")).select("source_id")


@register("SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.event_id AND l.quality = 1)")
def j5_dismissed(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("event_id"))
    return table(spark, sf_dir, "events").select("event_id").join(gone, "event_id", "left_anti")


@register("SELECT d.doc_id, l.quality, p.url FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id")
def j6_orphans_kept(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").join(p, "doc_id", "left")


@register("""SELECT c_custkey, n_name, r_name, coalesce(n, 0) AS orders, coalesce(total, 0) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def j7_member_listing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@register(f"WITH {W.VERSIONS} SELECT d.doc_id, v.version_id FROM documents d JOIN ver v ON v.sha256 = sha256(d.text) AND v.source_id % 4 = d.doc_id % 4")
def j9_duplicate_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 4).alias("w"))
    v = W.versions(spark, sf_dir).select("version_id", "sha256", (F.col("source_id") % 4).alias("w"))
    return d.join(v, ["sha256", "w"]).select("doc_id", "version_id")


@register("""SELECT conv_id, coalesce((SELECT arg_min(source, doc_id) FROM documents WHERE doc_id % 40 = conv_id), 'Untitled') AS title FROM (SELECT DISTINCT conv_id FROM conversations)""")
def j10_first_attached(spark, sf_dir):
    first = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 40).alias("conv_id")).agg(F.min_by("source", "doc_id").alias("t"))
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.join(first, "conv_id", "left").select("conv_id", F.coalesce("t", F.lit("Untitled")).alias("title"))


@register("SELECT l.doc_id, p.page_id IS NOT NULL AS found, length(p.html) AS n FROM labels l LEFT JOIN pages p ON p.page_id = l.doc_id")
def j11_page_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("x"), F.length("html").cast("long").alias("n"))
    return table(spark, sf_dir, "labels").join(p, F.col("doc_id") == F.col("x"), "left").select("doc_id", F.col("x").isNotNull().alias("found"), "n")


@register("""SELECT DISTINCT b.conv_id, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.text LIKE '%ing%' AND a.role = 'user'""")
def j12_neighbours(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    hits = c.filter("text LIKE '%ing%' AND role = 'user'").select("conv_id", F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"))
    return c.select("conv_id", "turn").join(hits.distinct(), ["conv_id", "turn"], "left_semi")


@register(f"WITH {W.VERSIONS} SELECT source_id, version_id FROM cur WHERE is_current")
def j18_current_version(spark, sf_dir):
    return M.promote(W.versions(spark, sf_dir)).filter("is_current").select("source_id", "version_id")


@register(f"WITH {W.FINDINGS} SELECT f.requirement_id, f.result, p.p_name FROM fnd f JOIN part p ON p.p_partkey = f.requirement_id")
def j19_findings_requirements(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("requirement_id"), "p_name")
    return W.findings(spark, sf_dir).join(p, "requirement_id").select("requirement_id", "result", "p_name")


_ASKED = "ask AS (SELECT o_custkey AS user_id, o_orderkey AS consultation_id, o_orderkey % (SELECT count(*) FROM documents) AS source_id FROM orders)"


def _asked(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("consultation_id"), (F.col("o_orderkey") % n).alias("source_id"))


@register(f"""{_WORLD}, {W.VERSIONS}, {_ASKED} SELECT consultation_id, a.source_id, version_id, CASE WHEN promoted THEN 'governing' ELSE 'project' END AS role
FROM ask a JOIN vis USING (user_id, source_id) JOIN cur ON cur.source_id = a.source_id AND is_current JOIN src ON src.source_id = a.source_id""")
def j20_pinned_sources(spark, sf_dir):
    asked = _asked(spark, sf_dir).withColumn("role", F.lit("governing"))
    return A.pinned(asked, _among(spark, sf_dir, asked), M.promote(W.versions(spark, sf_dir)), W.sources(spark, sf_dir))


@register(f"{_WORLD}, {_ASKED} SELECT consultation_id FROM ask WHERE NOT EXISTS (SELECT 1 FROM vis WHERE vis.user_id = ask.user_id AND vis.source_id = ask.source_id)")
def g2_leaks(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    return A.leaks(asked, _among(spark, sf_dir, asked)).select("consultation_id")


@register(f"""{_WORLD}, {_ASKED} SELECT user_id, count(*) AS asked, count(*) FILTER (WHERE v.source_id IS NULL) AS missing, count(*) FILTER (WHERE v.source_id IS NULL) = 0 AS allowed
FROM ask LEFT JOIN vis v USING (user_id, source_id) GROUP BY user_id""")
def g4_batch_guard(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    return A.batch_guard(asked, _among(spark, sf_dir, asked))


@register("""WITH m AS (SELECT c_custkey AS user_id, c_custkey % 7 AS r FROM customer) SELECT user_id, CASE r WHEN 0 THEN 45 WHEN 1 THEN 43 ELSE 0 END > 0 AS senior FROM m""")
def g1_access_audit(spark, sf_dir):
    role = F.element_at(F.array(*map(F.lit, A.ROLE_ORDER)), (F.col("c_custkey") % 7 + 1).cast("int"))
    g = A.grants(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), role.alias("role")))
    return g.groupBy("user_id").agg(F.bool_or(F.col("permission") == "settings:security").alias("senior"))


@register(f"""WITH {W.SOURCES} SELECT source_id, CASE WHEN source_id % 10 = 2 AND source_id % 4 > 0 AND source_id % 6 < 3 THEN 'failed' WHEN source_id % 10 = 2 THEN 'pending' ELSE status END AS status FROM src""")
def g3_abandoned_uploads(spark, sf_dir):
    s = W.sources(spark, sf_dir).select("source_id", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")).alias("status"))
    have = s.filter("source_id % 4 = 0").select("source_id")
    tickets = s.select("source_id", F.when(F.col("source_id") % 6 < 3, W.as_of() - F.expr("INTERVAL 1 DAY")).otherwise(W.as_of()).alias("expires_at"))
    return A.abandoned_uploads(s, have, tickets, W.as_of())


@register(f"WITH {W.SOURCES} SELECT source_id FROM src WHERE status = 'ready' AND document_type = 'en' AND owner_user_id = 7")
def p1_facets(spark, sf_dir):
    wanted, out = {"status": "ready", "document_type": "en", "owner_user_id": 7, "role": "all"}, W.sources(spark, sf_dir)
    for column, value in wanted.items():
        if value != "all":
            out = out.filter(F.col(column) == value)
    return out.select("source_id")


@register("SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%c1%'")
def p2_substring_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").ilike("%license%") | F.col("source").ilike("%c1%")).select("doc_id")


@register(f"WITH {W.SOURCES} SELECT source_id FROM src WHERE list_contains(tags, 'de')")
def p3_tag(spark, sf_dir):
    return W.sources(spark, sf_dir).filter(F.array_contains("tags", "de")).select("source_id")


@register("SELECT count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS half_open, count(*) AS closed FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-01-01'")
def p4_ranges(spark, sf_dir):
    a, b = F.lit("1995-01-01").cast("timestamp"), F.lit("1996-01-01").cast("timestamp")
    o = table(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= a) & (F.col("o_orderdate") <= b))
    return o.agg(F.count_if(F.col("o_orderdate") < b).alias("half_open"), F.count(F.lit(1)).alias("closed"))


@register(f"WITH {W.SOURCES} SELECT source_id FROM src WHERE last_synced_at < TIMESTAMP '2026-06-30' - INTERVAL 180 DAY")
def p5_stale(spark, sf_dir):
    return W.sources(spark, sf_dir).filter(F.col("last_synced_at") < W.as_of() - F.expr("INTERVAL 180 DAYS")).select("source_id")


@register("SELECT p_partkey FROM part WHERE '6.' || (p_partkey % 30) || '.' || p_size LIKE '6.4.%' OR '6.' || (p_partkey % 30) || '.' || p_size LIKE '6.7.%'")
def p6_prefix(spark, sf_dir):
    clause = F.concat_ws(".", F.lit("6"), (F.col("p_partkey") % 30).cast("string"), F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.substring_index(clause, ".", 2).alias("loc"))
    wanted = table(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.concat(F.lit("6."), (F.col("r_regionkey") * 3 + 4).cast("string")).alias("loc"))
    return rows.join(wanted, "loc", "left_semi").select("p_partkey")


@register("SELECT p_partkey, concat_ws(' > ', nullif(trim(CASE WHEN p_size % 2 = 0 THEN '  ' ELSE p_brand END), ''), p_name) AS heading, p_size % 2 IS DISTINCT FROM nullif(p_size % 3, 0) AS changed FROM part")
def p7_empty_safe(spark, sf_dir):
    brand = F.when(F.col("p_size") % 2 == 0, "  ").otherwise(F.col("p_brand"))
    three = F.nullif(F.col("p_size") % 3, F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" > ", F.nullif(F.trim(brand), F.lit("")), "p_name").alias("heading"), (~(F.col("p_size") % 2).eqNullSafe(three)).alias("changed"))


@register(f"WITH {W.SOURCES} SELECT source_id, CASE WHEN role = 'governing' AND NOT promoted THEN 'project' ELSE role END AS role FROM src")
def p8_effective_role(spark, sf_dir):
    return W.sources(spark, sf_dir).select("source_id", A.effective_role(F.col("role"), F.col("promoted")).alias("role"))


@register(f"""WITH {W.FINDINGS} SELECT 'compliant_needs_confidence' AS rule, requirement_id::VARCHAR AS key FROM fnd WHERE result = 'compliant' AND confidence < 0.95
  UNION ALL SELECT 'risk_valid', requirement_id::VARCHAR FROM fnd WHERE risk = 'critical'""")
def p9_invariants(spark, sf_dir):
    rules = {
        "result_valid": F.col("result").isin("compliant", "non_compliant", "needs_evidence", "not_assessed"), "confidence_in_range": F.col("confidence").between(0, 1),
        "compliant_needs_confidence": (F.col("result") != "compliant") | (F.col("confidence") >= 0.95), "risk_valid": F.col("risk") != "critical",
    }
    return A.violations(W.findings(spark, sf_dir), "requirement_id", rules)


@register("SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def p10_uniqueness(spark, sf_dir):
    return A.repeated_keys(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha")), ["sha"])


@register("SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS live, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS expired FROM events")
def p12_expired(spark, sf_dir):
    gone = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return table(spark, sf_dir, "events").agg(F.count_if(~gone).alias("live"), F.count_if(gone).alias("expired"))


@register(f"WITH {W.SOURCES} SELECT source_id, CASE WHEN deleted_at IS NOT NULL THEN 'archived' ELSE status END AS status FROM src")
def p13_archive_deleted(spark, sf_dir):
    return W.sources(spark, sf_dir).select("source_id", F.when(F.col("deleted_at").isNotNull(), "archived").otherwise(F.col("status")).alias("status"))
