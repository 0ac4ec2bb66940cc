"""Queries over imports, triage, sinks and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import ingest as I
from attestry.plans import world as W
from attestry.plans.text import _TEXT
from attestry.plans.world import table
from attestry.registry import register
from attestry.sources import connectors as S
from attestry.sources.store import Store
from attestry.streaming import jobs as D
from attestry.streaming.sink import run_to_end, scratch


@register(f"WITH {W.SOURCES} SELECT source_id FROM src WHERE workspace_id = 2 AND deleted_at IS NULL")
def s1_workspace_scan(spark, sf_dir):
    return S.scan_workspace(W.sources(spark, sf_dir), 2).select("source_id")


@register(f"SELECT page_id AS version_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_TEXT}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text FROM pages")
def s2_read_pages(spark, sf_dir):
    return S.read_pages(table(spark, sf_dir, "pages"), "page_id", "html", F.lit("html")).select("version_id", F.md5("text").alias("text"))


@register("SELECT n_regionkey AS sheet, string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def s3_sheet_text(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("sheet"), F.col("n_nationkey").alias("_at"), F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))
    return S.sheet_text(rows, "sheet")


_MANIFEST = """m AS (SELECT doc_id, doc_id % 5 AS connector_id, CASE WHEN doc_id % 13 = 0 THEN 'exe' ELSE 'txt' END AS ext, doc_id % 17 = 0 AS big, sha256(text) AS sha FROM documents),
k AS (SELECT *, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id < 50 AND sha256(d.text) = sha) AS known, ext = 'exe' OR big AS bad FROM m),
d AS (SELECT *, row_number() OVER (PARTITION BY connector_id, sha, bad ORDER BY doc_id) > 1 AS again FROM k),
o AS (SELECT doc_id, connector_id, CASE WHEN bad THEN 'skipped' WHEN known OR again THEN 'present' ELSE 'imported' END AS kind FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY connector_id, kind ORDER BY doc_id) AS nth FROM o)"""


@register(f"WITH {_MANIFEST} SELECT doc_id, CASE WHEN kind = 'imported' AND nth > 100 THEN 'deferred' ELSE kind END AS outcome FROM n")
def s4_import_files(spark, sf_dir):
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    manifest = d.select(
        "doc_id", k.alias("external_id"), (k % 5).alias("connector_id"), F.concat(F.lit("f"), k.cast("string"), F.when(k % 13 == 0, ".exe").otherwise(".TXT")).alias("name"),
        F.when(k % 17 == 0, F.lit(S.MOST_BYTES + 1)).otherwise(F.lit(1000)).alias("size_bytes"), F.sha2("text", 256).alias("sha256"),
    )
    known = d.filter("doc_id < 50").select(F.sha2("text", 256).alias("sha256"))
    return S.import_files(manifest, known, 100).select("doc_id", "outcome")


@register("SELECT page_id, CASE WHEN lower(split_part(url, '?', 1)) LIKE '%.pdf' THEN 'pdf' ELSE 'html' END AS document_type, 'website' AS origin, url AS final_url FROM pages")
def s5_websites(spark, sf_dir):
    return S.import_websites(table(spark, sf_dir, "pages")).select("page_id", "document_type", "origin", "final_url")


@register("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'executable' WHEN 3 THEN 'legacy_office' ELSE 'txt' END AS kind, doc_id % 5 NOT IN (2, 3) AND doc_id % 7 > 0 AS accepted FROM documents")
def s6_triage(spark, sf_dir):
    k = F.col("doc_id")
    head = F.element_at(F.array(*map(F.lit, ("25504446", "504B0304", "4D5A9000", "D0CF11E0A1B11AE1", "68656C6C6F"))), (k % 5 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".docx", ".pdf", ".doc", ".txt"))), (k % 5 + 1).cast("int"))
    body = F.concat(F.unhex(head), F.when(k % 7 == 0, S.EICAR).otherwise("x").cast("binary"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(k.cast("string"), ext).alias("path"), body.alias("content"))
    return S.triage(files).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "kind", "accepted")


@register("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'csv' ELSE 'other' END AS document_type FROM documents")
def s7_document_type(spark, sf_dir):
    k = (F.col("doc_id") % 4 + 1).cast("int")
    mime = F.element_at(F.array(*map(F.lit, ("application/pdf; v=1", "Text/HTML", "application/octet-stream", "x/y"))), k)
    name = F.element_at(F.array(*map(F.lit, ("a", "b", "t.CSV", "noext"))), k)
    return table(spark, sf_dir, "documents").select("doc_id", S.document_type(mime, name).alias("document_type"))


@register(f"""WITH {W.CHUNKS} SELECT version_id, ordinal, md5(content) AS digest FROM chk WHERE version_id % 50 > 0
UNION ALL SELECT doc_id, 1, md5('second reading of ' || doc_id) FROM documents WHERE doc_id % 100 = 50""")
def s8_replace_versions(spark, sf_dir):
    """Every fiftieth version of all stored passages is replaced, twice; one in two of these has a new passage, the others none."""
    passages = W.chunks(spark, sf_dir).select("version_id", F.col("ordinal").cast("int").alias("ordinal"), "content")
    store = Store(spark, scratch(spark), {"passages": "version_id"})
    store.commit(add={"passages": passages})
    gone = table(spark, sf_dir, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("version_id"))
    text = F.concat(F.lit("second reading of "), F.col("version_id").cast("string"))
    new = gone.filter("version_id % 100 = 50").select("version_id", F.lit(1).alias("ordinal"), text.alias("content"))
    for _ in range(2):
        S.replace_versions(store, "passages", new, gone)
    return store.read("passages").select("version_id", "ordinal", F.md5("content").alias("digest"))


@register("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def s9_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").withColumn("v", F.struct("ts", "event_id"))
    return S.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "v").select("user_id", "value")


@register("SELECT DISTINCT user_id, event_type FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 37 = 1 AND o.user_id = e.user_id AND o.event_type = e.event_type)")
def s10_insert_absent(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return S.insert_absent(e.filter("event_id % 2 = 0"), e.filter("event_id % 37 = 1"), ["user_id", "event_type"]).select("user_id", "event_type")


@register("""SELECT '"' || p_partkey || '","' || replace(p_name || ' "q"', '"', '""') || '"' AS line FROM part""")
def s12_csv_lines(spark, sf_dir):
    return S.csv_lines(table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(' "q"')).alias("name")))


@register("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN false WHEN page_id % 3 = 0 THEN true ELSE page_id % 5 > 0 END AS allowed FROM pages")
def j15_robots(spark, sf_dir):
    k = F.col("page_id")
    urls = table(spark, sf_dir, "pages").select(k.alias("url_id"), F.concat(F.lit("h"), k.cast("string")).alias("host"), F.lit("/docs/a/b").alias("path"))
    rules = urls.select("host", F.col("url_id").alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select(
        "host", F.when(F.col("n") == 0, "/docs").otherwise(F.when(F.col("k") % 3 == 0, "/docs").otherwise("/zzz")).alias("prefix"),
        F.when(F.col("k") % 2 == 0, False).otherwise(F.when(F.col("n") == 0, (F.col("k") % 3 > 0) & (F.col("k") % 5 > 0)).otherwise(True)).alias("allow"),
    )
    return S.robots_decision(urls, rules).withColumnRenamed("url_id", "page_id")


_HOST = "lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1))"


@register(f"SELECT page_id FROM pages WHERE {_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com' OR {_HOST} LIKE '%.example.net'")
def j16_allowed_hosts(spark, sf_dir):
    host = F.regexp_extract("url", "^[^:]+://([^/?#:]*)", 1)
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("url_id"), host.alias("host"))
    domains = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "Example.com").when(F.col("r_regionkey") == 1, "example.net").alias("domain")).filter("domain IS NOT NULL")
    return S.allowed_hosts(urls, domains).select(F.col("url_id").alias("page_id"))


@register("SELECT user_id AS job_id, event_type AS stage, ts, CASE WHEN value > 50 THEN 'hot' ELSE 'cold' END AS after FROM events QUALIFY lag(CASE WHEN value > 50 THEN 'hot' ELSE 'cold' END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS DISTINCT FROM CASE WHEN value > 50 THEN 'hot' ELSE 'cold' END")
def d3_stage_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), "ts", "event_id", F.when(F.col("value") > 50, "hot").otherwise("cold").alias("state"))
    return D.stage_changes_batch(e).select("job_id", "stage", "ts", "after")


@register("SELECT user_id AS job_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def d4_stale_jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts")
    last = e.agg(F.max("ts")).first()[0]
    return D.stale_jobs_batch(e, F.lit(last), 6 * 3600)


def _stream(spark, sf_dir, query, name, mode="append"):
    """Runs a streaming query over the events file to its end and returns what the sink got."""
    out = run_to_end(spark, query, name, mode)
    kind = table(spark, sf_dir, "events").schema["ts"].dataType
    return out.withColumn("window_start", F.col("window_start").cast(kind)) if "window_start" in out.columns else out


@register("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def d1_request_windows(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    e = D.read_events(spark, f"{sf_dir}/events.parquet*", schema).filter("ts IS NOT NULL")
    return _stream(spark, sf_dir, D.request_windows(e, 3600), "d1", "complete")


@register("SELECT DISTINCT user_id, event_type FROM events")
def d2_accept_once(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    e = D.read_events(spark, f"{sf_dir}/events.parquet*", schema).filter("ts IS NOT NULL")
    return _stream(spark, sf_dir, D.accept_once(e, ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "d2")


@register("SELECT event_type AS kind, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS count, round(sum(value), 3) AS sum FROM events GROUP BY 1, 2")
def d6_metric_windows(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    e = D.read_events(spark, f"{sf_dir}/events.parquet*", schema).filter("ts IS NOT NULL").withColumnRenamed("event_type", "kind")
    out = _stream(spark, sf_dir, D.metric_windows(e, 360), "d6", "complete")
    return out.select("kind", "window_start", "count", F.round("sum", 3).alias("sum"))



@register("""SELECT '"' || p_partkey || '","' || p_brand || '"' AS line FROM part""")
def s13_evidence_csv(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lit(None).cast("string").alias("source"), F.lit("x").alias("page"))
    return S.csv_lines(S.evidence_columns(rows, ["source", "page"], "source"))


@register("SELECT user_id AS job_id, event_type AS stage, ts, CASE WHEN value > 50 THEN 'hot' ELSE 'cold' END AS after FROM events QUALIFY lag(CASE WHEN value > 50 THEN 'hot' ELSE 'cold' END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS DISTINCT FROM CASE WHEN value > 50 THEN 'hot' ELSE 'cold' END")
def d3_stage_stream(spark, sf_dir):
    """The live feed of stage changes, run to its end."""
    kind = table(spark, sf_dir, "events").schema
    e = D.read_events(spark, f"{sf_dir}/events.parquet*", kind).filter("ts IS NOT NULL")
    e = e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), "ts", "event_id", F.when(F.col("value") > 50, "hot").otherwise("cold").alias("state"))
    out = run_to_end(spark, D.stage_changes(e), "d3", stateful=True)
    return out.select("job_id", "stage", F.col("ts").cast(kind["ts"].dataType).alias("ts"), "after")


@register("""SELECT user_id AS job_id, ts AS last_seen FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next, max(ts) OVER () AS ends FROM (SELECT DISTINCT user_id, ts FROM events))
WHERE coalesce(next, ends) - ts > INTERVAL 6 HOUR""")
def d4_stale_stream(spark, sf_dir):
    """Each silence of a job of more than six hours, by event-time timers of a live feed run to its end."""
    kind = table(spark, sf_dir, "events").schema
    e = D.read_events(spark, f"{sf_dir}/events.parquet*", kind).filter("ts IS NOT NULL").select(F.col("user_id").alias("job_id"), "ts")
    out = run_to_end(spark, D.stale_jobs(e, 6 * 3600, "0 seconds"), "d4", stateful=True)
    return out.select("job_id", F.col("last_seen").cast(kind["ts"].dataType).alias("last_seen"))


class _FailsOnce(Store):
    """A store whose second commit fails after everything but the manifest is written."""

    calls = 0

    def _publish(self, manifest):
        self.calls += 1
        if self.calls == 2:
            raise OSError("stopped before the commit")
        super()._publish(manifest)


_CLEAN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_TEXT}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_JOINED = f"regexp_replace({_CLEAN}, '(\\p{{L}})-(?:[ \\t]*\\r?\\n[ \\t]*|[ \\t]+)(\\p{{Ll}})', '\\1\\2', 'g')"


@register(f"""WITH p AS (SELECT page_id, page_id % 20 AS source_id, page_id % 2 AS dropped, sha256(html) AS sha256, {_JOINED} AS text FROM pages),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY dropped, page_id) = 1),
v AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY dropped, page_id)::INT AS version_number FROM n)
SELECT page_id AS version_id, source_id, version_number, sha256, md5(text) AS digest, CASE WHEN text = '' THEN 'needs_review' ELSE 'ready' END AS outcome,
  row_number() OVER (PARTITION BY source_id ORDER BY version_number DESC) = 1 AS is_current FROM v""")
def d5_ingest_stream(spark, sf_dir):
    """Two drops of pages through the whole ingest, the job failing in the middle of the second and restarted."""
    work = scratch(spark)
    pages = table(spark, sf_dir, "pages")
    files = pages.select(F.col("page_id").alias("file_id"), (F.col("page_id") % 20).alias("source_id"), F.col("html").alias("text"), F.lit("html").alias("kind"))
    store = _FailsOnce(spark, f"{work}/store", I.TABLES)

    def run():
        stream = spark.readStream.schema(files.schema).parquet(f"{work}/in/drop=*")
        D.ingest_new(stream, store, f"{work}/state", f"{work}/scratch", W.as_of()).awaitTermination()

    files.filter("file_id % 2 = 0").write.parquet(f"{work}/in/drop=0")
    run()
    files.filter("file_id % 2 = 1").write.parquet(f"{work}/in/drop=1")
    try:
        run()
    except Exception as error:
        if "stopped before the commit" not in str(error):
            raise
    run()
    text = store.read("pages").select("version_id", F.md5("text").alias("digest"))
    told = I.current_versions(store).join(text, "version_id").join(store.read("outcomes"), "version_id")
    return told.select("version_id", "source_id", "version_number", "sha256", "digest", "outcome", "is_current")
