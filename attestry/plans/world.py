"""The given tables seen as this library's entities, in Spark and, with the same columns, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all cores by its keys: a file of short rows is few tasks, and long expressions over it keep only these busy."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def as_of() -> Column:
    """The instant that queries take for now."""
    return F.lit("2026-06-30").cast("timestamp")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        k.alias("source_id"), (k % 4).alias("workspace_id"), F.concat(F.lit("Document "), k.cast("string")).alias("title"),
        F.col("lang").alias("document_type"),
        F.when(k % 10 == 0, "failed").when(k % 10 == 1, "needs_review").when(k % 10 == 2, "processing").otherwise("ready").alias("status"),
        (k % 150).alias("owner_user_id"), F.when(k % 5 == 0, "workspace").otherwise("restricted").alias("access_scope"),
        (k % 3 == 0).alias("promoted"), F.when(k % 17 == 0, as_of()).alias("deleted_at"),
        (as_of() - F.make_dt_interval((k % 400).cast("int"))).alias("last_synced_at"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("source", "lang")).alias("tags"),
        F.when(F.col("lang") == "en", "governing").otherwise("project").alias("role"), "text", F.col("source").alias("origin"),
    )


SOURCES = """src AS (
  SELECT doc_id AS source_id, doc_id % 4 AS workspace_id, 'Document ' || doc_id AS title, lang AS document_type,
    CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN doc_id % 10 = 1 THEN 'needs_review' WHEN doc_id % 10 = 2 THEN 'processing' ELSE 'ready' END AS status,
    doc_id % 150 AS owner_user_id, CASE WHEN doc_id % 5 = 0 THEN 'workspace' ELSE 'restricted' END AS access_scope,
    doc_id % 3 = 0 AS promoted, CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2026-06-30' END AS deleted_at,
    TIMESTAMP '2026-06-30' - INTERVAL 1 DAY * (doc_id % 400) AS last_synced_at,
    CASE WHEN doc_id % 7 = 0 THEN [] ELSE [source, lang] END AS tags,
    CASE WHEN lang = 'en' THEN 'governing' ELSE 'project' END AS role, text, source AS origin
  FROM documents)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of each source; the second is promoted for two sources in three."""
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("version_number"))
    promoted = F.when((F.col("version_number") == 1) | (F.col("source_id") % 3 < 2), as_of() - F.make_dt_interval(10 - F.col("version_number")))
    return base.select(
        (F.col("source_id") * 10 + F.col("version_number")).alias("version_id"), "source_id", "version_number",
        F.sha2(F.when(F.col("version_number") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"),
        promoted.alias("promoted_at"),
    )


VERSIONS = """ver AS (
  SELECT doc_id * 10 + v AS version_id, doc_id AS source_id, v AS version_number,
    sha256(CASE WHEN v = 1 THEN text || '!' ELSE text END) AS sha256,
    CASE WHEN v = 1 OR doc_id % 3 < 2 THEN TIMESTAMP '2026-06-30' - INTERVAL 1 DAY * (10 - v) END AS promoted_at
  FROM documents, (SELECT unnest([1, 2]) AS v)),
cur AS (
  SELECT *, promoted_at IS NOT NULL AND row_number() OVER (PARTITION BY source_id ORDER BY promoted_at DESC NULLS LAST, version_number DESC) = 1 AS is_current
  FROM ver)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels")
    result = (
        F.when(F.col("quality").isNull(), "not_assessed").when(F.col("toxic") == 1, "non_compliant").when(F.col("quality") == 1, "compliant").otherwise("needs_evidence")
    )
    risk = F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 10 == 0, "critical").otherwise("high")).when(F.col("quality") == 0, "medium").otherwise("none")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("requirement_id"), F.col("source").alias("review_id"), result.alias("result"), risk.alias("risk"),
        F.when(result == "compliant", 0.9).otherwise(0.5).alias("confidence"),
    )


FINDINGS = """fnd AS (
  SELECT d.doc_id AS requirement_id, d.source AS review_id,
    CASE WHEN l.quality IS NULL THEN 'not_assessed' WHEN l.toxic = 1 THEN 'non_compliant' WHEN l.quality = 1 THEN 'compliant' ELSE 'needs_evidence' END AS result,
    CASE WHEN l.toxic = 1 THEN CASE WHEN d.doc_id % 10 = 0 THEN 'critical' ELSE 'high' END WHEN l.quality = 0 THEN 'medium' ELSE 'none' END AS risk,
    CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 0.9 ELSE 0.5 END AS confidence
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as passages."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    return rows.select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("at").cast("string")).alias("chunk_id"), F.col("doc_id").alias("version_id"),
        (F.col("doc_id") % 50).alias("source_id"), F.col("at").alias("page_number"), (F.col("at") + 1).alias("ordinal"), "content",
        F.when(F.col("lang") == "en", "governing").otherwise("project").alias("role"),
    )


CHUNKS = """chk AS (
  SELECT doc_id || ':' || nth AS chunk_id, doc_id AS version_id, doc_id % 50 AS source_id, nth AS page_number, nth + 1 AS ordinal, content,
    CASE WHEN lang = 'en' THEN 'governing' ELSE 'project' END AS role
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS nth FROM documents))"""


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations out of the part table: a reference, a text and the figure that the text states."""
    k, n = F.col("p_partkey"), F.col("p_size")
    word = F.when(k % 3 == 0, "shall not exceed").when(k % 3 == 1, "shall be not less than").otherwise("must be")
    text = F.concat_ws(" ", F.lit("The clear width of exit stair"), k.cast("string"), word, n.cast("string"), F.lit("m at every landing of the building."))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(
        k.alias("requirement_id"), F.concat(F.lit("6."), k.cast("string")).alias("reference"), text.alias("obligation_text"),
        F.when(k % 3 == 0, "prohibited").otherwise("mandatory").alias("modality"), n.cast("double").alias("stated"),
        F.when(k % 3 == 0, "max").when(k % 3 == 1, "min").otherwise("equal").alias("direction"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence out of the line items: passages that state a figure for a part, in centimetres."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    text = F.concat_ws(" ", F.lit("Exit stair clear width at landing"), (F.col("l_quantity").cast("long") * 100).cast("string"), F.lit("cm as drawn."))
    return rows.select(
        F.col("l_partkey").alias("requirement_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), text.alias("content"), F.col("l_quantity").alias("drawn")
    )


def stem_sql(t: str) -> str:
    return (
        f"CASE WHEN length({t}) <= 4 THEN {t} WHEN {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN regexp_matches({t}, '(ss|x|z|ch|sh)es$') THEN left({t}, length({t}) - 2) "
        f"WHEN {t} LIKE '%s' AND NOT regexp_matches({t}, '[su]s$') THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def in_sql(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z]+(?:''[a-z]+)?|\\d+(?:\\.\\d+)*')"


def content_sql(text: str) -> str:
    return f"list_filter({tokens_sql(text)}, lambda t: length(t) > 1 AND t NOT IN {in_sql(T.STOPWORDS)})"
