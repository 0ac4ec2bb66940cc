"""Queries over workspace metrics, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.operators import compliance as C
from attestry.operators import metrics as M
from attestry.plans import world as W
from attestry.plans.world import table
from attestry.registry import register


@register("""WITH e AS (SELECT *, ts >= TIMESTAMP '2024-01-16' AS now FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'), k AS (
  SELECT 'events' AS kpi, count(*) FILTER (WHERE now)::DOUBLE AS current, count(*) FILTER (WHERE NOT now)::DOUBLE AS prior FROM e
  UNION ALL SELECT 'value', coalesce(sum(value) FILTER (WHERE now), 0), coalesce(sum(value) FILTER (WHERE NOT now), 0) FROM e
  UNION ALL SELECT 'users', count(DISTINCT user_id) FILTER (WHERE now), count(DISTINCT user_id) FILTER (WHERE NOT now) FROM e)
SELECT kpi, round(current, 4) AS current, round(prior, 4) AS prior, CASE WHEN prior = 0 THEN CASE WHEN current = 0 THEN 0.0 END ELSE round((current - prior) / prior * 1000) / 10 END AS change FROM k""")
def a2_period_change(spark, sf_dir):
    def at(d):
        return F.lit(d).cast("timestamp")

    measures = {"events": (F.count, F.col("event_id")), "value": (F.sum, F.col("value")), "users": (F.count_distinct, F.col("user_id"))}
    rows = M.period_kpis(table(spark, sf_dir, "events"), at("2024-01-01"), at("2024-01-16"), at("2024-01-31"), measures)
    return rows.select("kpi", F.round("current", 4).alias("current"), F.round("prior", 4).alias("prior"), "change")


@register(f"""WITH {W.FINDINGS}
SELECT review_id, count(*) AS findings, round(coalesce(count(*) FILTER (WHERE result = 'compliant') / nullif(count(*) FILTER (WHERE result <> 'not_assessed'), 0), 0), 6) AS rate FROM fnd GROUP BY review_id""")
def a1_compliance_rate(spark, sf_dir):
    return M.compliance_rate(W.findings(spark, sf_dir), ["review_id"]).select("review_id", "findings", F.round("rate", 6).alias("rate"))


@register("""WITH d AS (SELECT CAST(DATE '2023-12-25' + INTERVAL 1 DAY * i AS DATE) AS day FROM (SELECT unnest(range(50)) AS i))
SELECT d.day::TIMESTAMP AS day, count(e.event_id) AS n FROM d LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day GROUP BY d.day""")
def a3_daily_activity(spark, sf_dir):
    return M.daily_counts(table(spark, sf_dir, "events"), "2023-12-25", 50).select(F.col("day").cast("timestamp").alias("day"), "n")


@register(f"""WITH {W.FINDINGS} SELECT review_id, count(*) FILTER (WHERE result = 'compliant') AS compliant, count(*) FILTER (WHERE result = 'non_compliant') AS non_compliant,
  count(*) FILTER (WHERE result = 'needs_evidence') AS needs_evidence FROM fnd GROUP BY review_id""")
def a4_outcome_counts(spark, sf_dir):
    return M.outcome_counts(W.findings(spark, sf_dir), "result", ["compliant", "non_compliant", "needs_evidence"], ["review_id"])


@register(f"""WITH {W.SOURCES} SELECT workspace_id, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'processing') AS processing,
  count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE status = 'failed') AS failed FROM src WHERE deleted_at IS NULL GROUP BY workspace_id""")
def a5_status_counts(spark, sf_dir):
    live = W.sources(spark, sf_dir).filter("deleted_at IS NULL")
    return M.outcome_counts(live, "status", ["ready", "processing", "needs_review", "failed"], ["workspace_id"])


_HEALTH = f"""WITH {W.SOURCES}, {W.VERSIONS}, live AS (SELECT * FROM src WHERE deleted_at IS NULL),
g AS (SELECT workspace_id, count(*) AS duplicates FROM (SELECT workspace_id, sha256 FROM cur JOIN live USING (source_id) WHERE is_current GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
h AS (SELECT workspace_id, count(*) AS total, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'needs_review') AS needs_review,
  count(*) FILTER (WHERE last_synced_at < TIMESTAMP '2026-06-30' - INTERVAL 180 DAY) AS outdated, count(*) FILTER (WHERE len(tags) = 0) AS missing_metadata,
  count(*) FILTER (WHERE source_id % 6 > 0) AS unlinked, count(*) FILTER (WHERE source_id % 9 > 0) AS permission_issues FROM live GROUP BY 1)
SELECT h.*, coalesce(g.duplicates, 0) AS duplicates FROM h LEFT JOIN g USING (workspace_id)"""


def _health(spark, sf_dir):
    s = W.sources(spark, sf_dir)
    grants, linked = s.filter("source_id % 9 = 0").select("source_id"), s.filter("source_id % 6 = 0").select("source_id")
    return M.health_inputs(s, M.promote(W.versions(spark, sf_dir)), grants, linked, W.as_of())


@register(_HEALTH)
def a6_health_inputs(spark, sf_dir):
    return _health(spark, sf_dir)


@register(f"""WITH {W.VERSIONS} SELECT sha256, count(*) AS n FROM cur WHERE is_current GROUP BY sha256 HAVING count(*) > 1""")
def a7_duplicate_groups(spark, sf_dir):
    return M.duplicate_groups(M.promote(W.versions(spark, sf_dir)))


@register(f"""WITH i AS ({_HEALTH}) SELECT workspace_id, CAST(floor(100 * (0.4 * (total - failed - needs_review) / total + 0.15 * (total - outdated) / total + 0.15 * (total - missing_metadata) / total
  + 0.15 * (total - unlinked) / total + 0.1 * (1 - duplicates / total) + 0.05 * (total - permission_issues) / total) + 0.5) AS BIGINT) AS score FROM i""")
def a8_health_score(spark, sf_dir):
    c = F.col
    score = M.health_score(c("total"), c("failed"), c("needs_review"), c("outdated"), c("missing_metadata"), c("unlinked"), c("duplicates"), c("permission_issues"))
    return _health(spark, sf_dir).select("workspace_id", score.alias("score"))


@register(f"""WITH {W.CHUNKS} SELECT version_id, count(*) AS chunks, count(*) FILTER (WHERE content LIKE '%|%') AS tables, count(*) FILTER (WHERE length(content) < 40) AS headings FROM chk GROUP BY version_id""")
def a9_structure_counts(spark, sf_dir):
    return W.chunks(spark, sf_dir).groupBy("version_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.contains("content", F.lit("|"))).alias("tables"), F.count_if(F.length("content") < 40).alias("headings")
    )


@register(f"""WITH {W.CHUNKS}, c AS (SELECT version_id, sum(length(content)) AS c FROM chk WHERE ordinal % 3 > 0 GROUP BY 1)
SELECT doc_id AS version_id, round(CASE WHEN length(text) > 0 THEN least(1.0, coalesce(c / length(text), 0)) ELSE 0 END, 6) AS coverage FROM documents LEFT JOIN c ON version_id = doc_id""")
def a10_extraction_coverage(spark, sf_dir):
    from attestry.operators.corpus import extraction_coverage

    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), "text")
    return extraction_coverage(pages, W.chunks(spark, sf_dir).filter("ordinal % 3 > 0")).select("version_id", F.round("coverage", 6).alias("coverage"))


@register("""SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user, count(*) FILTER (WHERE role = 'assistant') AS assistant FROM conversations GROUP BY conv_id""")
def a11_pivot_roles(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").pivot("role", ["user", "assistant"]).count()
    return p.na.fill(0, ["user", "assistant"])


@register("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS queued FROM events GROUP BY event_type""")
def a12_job_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("queued"))


@register(f"""WITH {W.SOURCES} SELECT owner_user_id, count(*) AS total, count(*) FILTER (WHERE status = 'ready') AS ready, max(last_synced_at) AS last FROM src GROUP BY 1""")
def a13_totals(spark, sf_dir):
    return W.sources(spark, sf_dir).groupBy("owner_user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ready").alias("ready"), F.max("last_synced_at").alias("last"))


@register(f"""WITH {W.SOURCES}, t AS (SELECT owner_user_id, regexp_replace(string_agg(title, '+' ORDER BY title), '\\s+', '_', 'g') AS t FROM src GROUP BY 1)
SELECT owner_user_id, CASE WHEN length(t) > 120 THEN left(t, 117) || '...' ELSE t END AS name FROM t""")
def a14_pooled_titles(spark, sf_dir):
    return M.pooled_title(W.sources(spark, sf_dir), "owner_user_id")


@register(f"""WITH {W.VERSIONS}, inc AS (SELECT doc_id % 100 AS source_id, sha256(text) AS sha256, min(doc_id) AS arrived FROM documents GROUP BY 1, 2),
n AS (SELECT * FROM inc ANTI JOIN ver USING (source_id, sha256)), m AS (SELECT source_id, max(version_number) AS last FROM ver GROUP BY 1)
SELECT source_id, sha256, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY source_id ORDER BY arrived, sha256) AS INT) AS version_number FROM n LEFT JOIN m USING (source_id)""")
def a15_next_versions(spark, sf_dir):
    inc = table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("source_id"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("arrived"))
    return M.next_versions(inc, W.versions(spark, sf_dir))


@register(f"""WITH {W.VERSIONS} SELECT version_id, is_current FROM cur""")
def a16_promote(spark, sf_dir):
    return M.promote(W.versions(spark, sf_dir)).select("version_id", "is_current")


@register("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT event_type, count(*) AS count, round(sum(value), 3) AS sum, quantile_disc(value, 0.5) FILTER (WHERE r <= 500) AS p50, quantile_disc(value, 0.95) FILTER (WHERE r <= 500) AS p95,
  quantile_disc(value, 0.99) FILTER (WHERE r <= 500) AS p99 FROM r GROUP BY event_type""")
def a17_metric_points(spark, sf_dir):
    return M.metric_points(table(spark, sf_dir, "events"), ["event_type"], 500).withColumn("sum", F.round("sum", 3))


@register(f"""WITH {W.CHUNKS}, t AS (SELECT chunk_id, unnest({W.content_sql('content')}) AS term FROM chk)
SELECT term, count(*) AS tf, count(DISTINCT chunk_id) AS df FROM t GROUP BY term""")
def a18_term_counts(spark, sf_dir):
    return M.term_counts(W.chunks(spark, sf_dir), "chunk_id", "version_id")


_JOBS = """j AS (SELECT event_id AS job_id, user_id AS source_id, ts AS started_at, event_id % 7 AS k FROM events),
newest AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, job_id DESC) = 1),
batch AS (SELECT * FROM newest WHERE k = 0 OR started_at >= (SELECT max(started_at) FROM newest) - INTERVAL 600 MINUTE)"""


@register(f"""WITH {_JOBS}, s AS (SELECT 'scan' AS stage, CASE WHEN k = 0 THEN 'running' ELSE 'complete' END AS state FROM batch
  UNION ALL SELECT 'embed', CASE WHEN k = 3 THEN 'blocked' ELSE 'complete' END FROM batch UNION ALL SELECT 'chunk', 'complete' FROM batch)
SELECT stage, count(*) FILTER (WHERE state = 'complete') AS complete, count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'blocked') AS blocked,
  CASE WHEN count(*) FILTER (WHERE state = 'blocked') > 0 THEN 'blocked' WHEN count(*) FILTER (WHERE state = 'running') > 0 THEN 'running' ELSE 'complete' END AS state FROM s GROUP BY stage""")
def a19_stage_rollup(spark, sf_dir):
    k = F.col("event_id") % 7

    def stage(name, state):
        return F.struct(F.lit(name).alias("key"), state.alias("state"))

    jobs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("started_at"), F.when(k == 0, "running").otherwise("done").alias("status"),
        F.array(stage("scan", F.when(k == 0, "running").otherwise("complete")), stage("embed", F.when(k == 3, "blocked").otherwise("complete")), stage("chunk", F.lit("complete"))).alias("stages"),
    )
    return M.stage_rollup(jobs, 600)


@register("""SELECT d.doc_id AS version_id, count(l.doc_id) AS chunks FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id""")
def a22_index_audit(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("x"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"))
    return d.join(labels, d["version_id"] == F.col("x"), "left").groupBy("version_id").agg(F.count("x").alias("chunks"))


@register("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE value > 90) AS failed FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE value > 90) > 0.05 * count(*)""")
def a23_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("value") > 90)
    return M.alerts(e, 360, 0.05)


@register("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, * FROM events),
q AS (SELECT event_type, ts, sum(CASE WHEN value > 50 THEN 1 ELSE -1 END) AS delta FROM events GROUP BY 1, 2),
d AS (SELECT *, sum(delta) OVER (PARTITION BY event_type ORDER BY ts) > 10 AS over FROM q),
f AS (SELECT * FROM (SELECT *, coalesce(lag(over) OVER (PARTITION BY event_type ORDER BY ts), false) AS was, max(ts) OVER (PARTITION BY event_type) AS ends FROM d) WHERE over <> was),
s AS (SELECT event_type, over, ts, coalesce(lead(ts) OVER (PARTITION BY event_type ORDER BY ts), ends) AS until FROM f)
SELECT 'queue' AS kind, event_type AS subject, ts AS start, round(epoch(until) / 60 - epoch(ts) / 60, 3) AS value FROM s WHERE over AND until >= ts + INTERVAL 60 MINUTE
UNION ALL SELECT 'failures', '', start, round(count(*) FILTER (WHERE value > 90) / count(*), 6) FROM w GROUP BY start HAVING count(*) FILTER (WHERE value > 90) > 0.12 * count(*)
UNION ALL SELECT 'verification', '', start, round(avg(CASE WHEN value > 1 THEN 1.0 ELSE 0.0 END), 6) FROM w GROUP BY start HAVING NOT bool_and(value > 1)
UNION ALL SELECT 'retrieval', '', start, round(quantile_disc(value, 0.95), 6) FROM w GROUP BY start HAVING quantile_disc(value, 0.95) > 95""")
def a23_all_alerts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    queue = e.select(F.col("event_type").alias("queue"), "ts", F.when(F.col("value") > 50, 1).otherwise(-1).alias("delta"))
    runs, cited = e.select("ts", (F.col("value") > 90).alias("failed")), e.select("ts", (F.col("value") > 1).alias("verified"))
    told = M.all_alerts(runs, queue, cited, e.select("ts", F.col("value").alias("seconds")), 360, 0.12, 10, 60, 95)
    return told.withColumn("value", F.when(F.col("kind") == "queue", F.round("value", 3)).otherwise(F.round("value", 6)))


@register("SELECT event_type, count(*) AS count, round(sum(value), 3) AS sum, true AS near FROM events GROUP BY event_type")
def a17_merged_sketches(spark, sf_dir):
    """Sketches of six-hour windows merged for each label; the ranks of the told quantiles are off by at most 0.02."""
    e = table(spark, sf_dir, "events")
    points = M.merged_points(M.metric_sketches(e, ["event_type"], 360), ["event_type"])
    met = e.select("event_type", "value").join(points.select("event_type", "p50", "p95", "p99"), "event_type").groupBy("event_type")
    off = [F.abs(F.avg((F.col("value") <= F.col(f"p{int(q * 100)}")).cast("double")) - q) <= F.greatest(F.lit(0.02), 1 / F.count(F.lit(1))) for q in M.QUANTILES]
    near = met.agg((off[0] & off[1] & off[2]).alias("near"))
    return points.join(near, "event_type").select("event_type", "count", F.round("sum", 3).alias("sum"), "near")


@register("""WITH p AS (SELECT DISTINCT l_suppkey, l_linenumber AS page FROM lineitem), g AS (SELECT *, page - row_number() OVER (PARTITION BY l_suppkey ORDER BY page) AS g FROM p),
r AS (SELECT l_suppkey, min(page) AS a, max(page) AS b FROM g GROUP BY l_suppkey, g)
SELECT l_suppkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1""")
def a24_page_ranges(spark, sf_dir):
    return M.page_ranges(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("page")), "l_suppkey")


@register("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""")
def a25_latest_completed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return M.newest_per_key(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("latest"))


@register("""SELECT event_type AS model, round(sum(value), 3) AS tokens, count(*) AS requests FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1""")
def a26_usage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = F.broadcast(e.agg(F.max("ts").alias("last")))  # one row
    recent = e.join(last, F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS"))
    return recent.groupBy(F.col("event_type").alias("model")).agg(F.round(F.sum("value"), 3).alias("tokens"), F.count(F.lit(1)).alias("requests"))


@register("""WITH w AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS s, count(*) AS n, max(CAST(floor(epoch(ts)) AS BIGINT) % 3600) AS late FROM events GROUP BY 1, 2)
SELECT user_id, make_timestamp(s * 1000000) AS window_start, n, round(n + CASE WHEN lag(s) OVER o = s - 3600 THEN lag(n) OVER o ELSE 0 END * (1 - late / 3600.0), 6) AS weighted FROM w WINDOW o AS (PARTITION BY user_id ORDER BY s)""")
def w10_rate_windows(spark, sf_dir):
    return M.rate_windows(table(spark, sf_dir, "events"), 3600).withColumn("weighted", F.round("weighted", 6))


@register("""SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def w8_neighbours(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("following"))


@register(f"""WITH {W.CHUNKS}, r AS (SELECT chunk_id, row_number() OVER (PARTITION BY version_id ORDER BY ordinal) - 1 AS r, count(*) OVER (PARTITION BY version_id) AS n FROM chk)
SELECT chunk_id FROM r WHERE r % greatest(n // 5, 1) = 0 AND r / greatest(n // 5, 1) < 5""")
def w9_stride_sample(spark, sf_dir):
    from attestry.operators.corpus import stride_sample

    return stride_sample(W.chunks(spark, sf_dir), "version_id", ["ordinal"], 5).select("chunk_id")


@register("""SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 10""")
def w1_channel_rank(spark, sf_dir):
    from attestry.operators.retrieve import top

    return top(table(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), "event_id"], 10).select("event_type", "event_id", "rank")


@register(f"""WITH {W.SOURCES} SELECT source_id, title, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 20) AS BIGINT) AS pages FROM src WHERE deleted_at IS NULL ORDER BY title, source_id LIMIT 20 OFFSET 40""")
def p11_page(spark, sf_dir):
    live = W.sources(spark, sf_dir).filter("deleted_at IS NULL").select("source_id", "title")
    return M.page_of(live, 3, 20, ["title", "source_id"]).select("source_id", "title", "total", "pages")


@register("""SELECT user_id, event_id, total, rank, total > 5 AS truncated FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS total,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5""")
def k9_capped_list(spark, sf_dir):
    return M.capped(table(spark, sf_dir, "events"), "user_id", [F.desc("value"), "event_id"], 5).select("user_id", "event_id", "total", "rank", "truncated")


@register(f"""WITH {W.FINDINGS}, w AS (SELECT *, CASE risk WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS w FROM fnd WHERE result IN ('non_compliant', 'needs_evidence'))
SELECT review_id, requirement_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY w DESC, requirement_id) AS rank FROM w) WHERE rank <= 8""")
def k7_actions(spark, sf_dir):
    from attestry.operators.retrieve import top

    weight = F.element_at(F.create_map(*[F.lit(x) for p in {"critical": 4, "high": 3, "medium": 2, "low": 1, "none": 0}.items() for x in p]), F.col("risk"))
    rows = W.findings(spark, sf_dir).filter(F.col("result").isin("non_compliant", "needs_evidence")).withColumn("w", weight)
    return top(rows, ["review_id"], [F.desc("w"), "requirement_id"], 8).select("review_id", "requirement_id", "rank")


@register(f"""WITH {W.FINDINGS}, {W.SOURCES}, a AS (
  SELECT 'critical_gap' AS kind, requirement_id AS item_id, requirement_id % 4 AS workspace_id, TIMESTAMP '2026-06-30' AS stamp FROM fnd WHERE risk = 'critical'
  UNION ALL SELECT 'stale_source', source_id, workspace_id, last_synced_at FROM src WHERE last_synced_at < TIMESTAMP '2026-06-30' - INTERVAL 180 DAY
  UNION ALL SELECT 'failed_job', event_id, event_id % 4, ts FROM events WHERE value > 95),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, workspace_id ORDER BY stamp DESC, item_id) AS r FROM a)
SELECT kind, item_id, workspace_id FROM r WHERE r <= 5 AND NOT (kind = 'failed_job' AND item_id % 3 = 0)""")
def x2_attention(spark, sf_dir):
    f = W.findings(spark, sf_dir).filter("risk = 'critical'").select(F.col("requirement_id").alias("item_id"), (F.col("requirement_id") % 4).alias("workspace_id"), W.as_of().alias("at"))
    s = W.sources(spark, sf_dir).filter(F.col("last_synced_at") < W.as_of() - F.expr("INTERVAL 180 DAYS")).select(F.col("source_id").alias("item_id"), "workspace_id", F.col("last_synced_at").alias("at"))
    e = table(spark, sf_dir, "events")
    j = e.filter("value > 95").select(F.col("event_id").alias("item_id"), (F.col("event_id") % 4).alias("workspace_id"), F.col("ts").alias("at"))
    gone = e.filter("event_id % 3 = 0").select(F.lit("failed_job").alias("kind"), F.col("event_id").alias("item_id"))
    return M.attention({"critical_gap": f, "stale_source": s, "failed_job": j}, 5, gone)


@register(f"""WITH {W.FINDINGS} SELECT review_id, CASE WHEN count(*) FILTER (WHERE risk = 'critical' AND result = 'non_compliant') > 0 OR count(*) FILTER (WHERE result = 'non_compliant') >= 3 THEN 'critical'
  WHEN count(*) FILTER (WHERE result = 'non_compliant') > 0 OR count(*) FILTER (WHERE result = 'needs_evidence') >= 5 THEN 'high' WHEN count(*) FILTER (WHERE result = 'needs_evidence') > 0 THEN 'medium' ELSE 'none' END AS risk,
  CAST(round(count(*) FILTER (WHERE result = 'compliant') / count(*) * 100) AS BIGINT) AS score FROM fnd GROUP BY review_id""")
def c15_rollup(spark, sf_dir):
    return C.review_rollup(W.findings(spark, sf_dir), "review_id").select("review_id", "risk", "score")


@register("""SELECT 'metric{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def s14_exposition(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return M.exposition(n, "metric", ["event_type"], "n")


@register("""WITH j AS (SELECT event_id AS job_id, event_type AS kind, CASE WHEN value > 50 THEN 'queued' ELSE 'running' END AS status, user_id % 10 AS priority, ts AS created_at,
  CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 1 DAY * (event_id % 900) END AS next_attempt_at FROM events)
SELECT kind, job_id, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY priority DESC, created_at, job_id) AS place FROM j
WHERE status = 'queued' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-06-30')) WHERE place <= 20""")
def k8_next_jobs(spark, sf_dir):
    k = F.col("event_id")
    jobs = table(spark, sf_dir, "events").select(
        k.alias("job_id"), F.col("event_type").alias("kind"), F.when(F.col("value") > 50, "queued").otherwise("running").alias("status"),
        (F.col("user_id") % 10).alias("priority"), F.col("ts").alias("created_at"),
        F.when(k % 3 > 0, F.col("ts") + F.make_dt_interval((k % 900).cast("int"))).alias("next_attempt_at"),
    )
    return M.next_jobs(jobs, F.lit("2024-06-30").cast("timestamp"), ["kind"], 20).select("kind", "job_id", "place")


@register(f"""WITH {W.SOURCES}, r AS (SELECT 'title' AS listing, source_id, row_number() OVER (ORDER BY title, source_id) AS place FROM src
UNION ALL SELECT 'updated', source_id, row_number() OVER (ORDER BY last_synced_at DESC, source_id) FROM src
UNION ALL SELECT 'status', source_id, row_number() OVER (ORDER BY status, last_synced_at DESC, source_id) FROM src
UNION ALL SELECT 'pinned', source_id, row_number() OVER (ORDER BY promoted DESC, last_synced_at DESC, source_id) FROM src)
SELECT listing, source_id, place FROM r WHERE place <= 100""")
def k10_listings(spark, sf_dir):
    s = W.sources(spark, sf_dir).select("source_id", "title", "status", F.col("promoted").alias("pinned"), F.col("last_synced_at").alias("updated_at"))
    parts = [M.listing(s, name, "source_id", 100).select("listing", "source_id", "place") for name in M.LISTINGS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
