"""Queries over structure, chunks, embeddings and screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import corpus as C
from attestry.operators import verify as V
from attestry.operators.ingest import derived, page_table
from attestry.plans import world as W
from attestry.plans.text import _TEXT
from attestry.plans.world import table
from attestry.registry import register


def _coded(spark, sf_dir):
    """A building code for every 200 parts: a chapter for each brand, a section for each type, a clause for each part."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.floor(F.col("p_partkey") / 200) + 1).cast("long").alias("version_id"), F.lit(1).alias("page_number"))
    n, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    lines = F.concat(
        F.lit("6."), n, F.lit("."), (F.col("p_partkey") % 900).cast("string"), F.lit(" Width of exit stair "), k, F.lit("\nThe clear width of the stair shall not exceed "), n,
        F.lit(" m at any landing. See clause 6.4.2 for doors. The handrail is fixed."),
    )
    text = F.array_join(F.array_sort(F.collect_list(F.struct("p_partkey", lines.alias("l"))))["l"], "\n")
    return p.groupBy("version_id", "page_number").agg(F.concat(F.lit("Foreword of the code.\nCHAPTER 6 EGRESS\n"), text).alias("text"))


@register("""SELECT p_partkey // 200 + 1 AS version_id, '6.' || p_size || '.' || p_partkey % 900 AS clause, '6' AS chapter, '6.' || p_size AS section, 'Width of exit stair ' || p_partkey AS title, 'clause' AS kind, 'prohibited' AS modality, true AS is_requirement
FROM part UNION ALL SELECT DISTINCT p_partkey // 200 + 1, NULL, NULL, NULL, 'Introduction', 'paragraph', NULL, false FROM part UNION ALL SELECT DISTINCT p_partkey // 200 + 1, NULL, '6', NULL, 'CHAPTER 6 EGRESS', 'heading', NULL, false FROM part""")
def r1_structure(spark, sf_dir):
    return C.sections(_coded(spark, sf_dir)).select("version_id", "clause", "chapter", "section", "title", "kind", "modality", "is_requirement")


@register("""WITH l AS (SELECT p_partkey // 200 + 1 AS version_id, '6.' || p_size || '.' || p_partkey % 900 AS clause, p_partkey AS id FROM part)
SELECT version_id, clause, 'CHAPTER 6 EGRESS > Width of exit stair ' || id AS path FROM l""")
def w6_heading_path(spark, sf_dir):
    s = C.sections(_coded(spark, sf_dir)).filter("clause IS NOT NULL")
    return s.select("version_id", "clause", F.array_join("heading_path", " > ").alias("path"))


@register("""WITH l AS (SELECT p_partkey // 200 + 1 AS version_id, p_partkey, p_size, length('6.' || p_size || '.' || p_partkey % 900 || ' Width of exit stair ' || p_partkey) + 1
  + length('The clear width of the stair shall not exceed ' || p_size || ' m at any landing. See clause 6.4.2 for doors. The handrail is fixed.') + 1 AS n FROM part)
SELECT version_id, 'Width of exit stair ' || p_partkey AS title, CAST(length('Foreword of the code.') + 1 + length('CHAPTER 6 EGRESS') + 1 + coalesce(sum(n) OVER (PARTITION BY version_id ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM l""")
def w7_running_offset(spark, sf_dir):
    return C.sections(_coded(spark, sf_dir)).filter("clause IS NOT NULL").select("version_id", "title", "char_start")


@register("""SELECT p_partkey // 200 + 1 AS version_id, 'Width of exit stair ' || p_partkey || chr(10) || 'The clear width of the stair shall not exceed ' || p_size || ' m at any landing. See clause 6.4.2 for doors. The handrail is fixed.' AS content FROM part
UNION ALL SELECT DISTINCT p_partkey // 200 + 1, 'CHAPTER 6 EGRESS' FROM part UNION ALL SELECT DISTINCT p_partkey // 200 + 1, 'Foreword of the code.' FROM part""")
def r4_section_chunks(spark, sf_dir):
    return C.section_chunks(C.sections(_coded(spark, sf_dir))).select("version_id", "content")


@register(None)
def r4_document_chunks(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), F.lit(1).alias("page_number"), "text")
    return C.section_chunks(C.sections(pages)).select("version_id", "ordinal", "token_count", F.md5("content").alias("digest"))


@register("""WITH r AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS k, l_orderkey || ' | ' || l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey AS version_id, CAST(i // 40 AS INT) AS paragraph_index, 'A' || (i // 40 * 40 + 1) || ':' || CASE WHEN count(*) = 1 THEN 'A' ELSE 'Z' END || (i // 40 * 40 + count(*)) AS cell_range FROM r GROUP BY l_suppkey, i // 40""")
def r5_sheet_chunks(spark, sf_dir):
    from attestry.sources.connectors import sheet_text

    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("version_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_at"),
        F.array(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("cells"),
    )
    pages = sheet_text(rows, "version_id").withColumn("page_number", F.lit(1))
    return C.sheet_chunks(pages).select("version_id", "paragraph_index", "cell_range")


@register("SELECT conv_id AS version_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS ordinal, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS content FROM conversations WHERE regexp_replace(text, '\\s+', '', 'g') <> ''")
def r6_slides(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("version_id"), F.col("turn").alias("page_number"), "text")
    return C.slide_chunks(p).select("version_id", "ordinal", "content")


@register("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || chr(10) || p_name ELSE p_name END AS input FROM part")
def r7_embedding_input(spark, sf_dir):
    h = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", C.embedding_input(h, F.col("p_name")).alias("input"))


def _fnv(c: str) -> str:
    return f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({c}, ''), lambda ch: CAST(unicode(ch) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


@register(f"""WITH w AS (SELECT item_id, list_transform({W.content_sql('text')}, lambda t: {W.stem_sql('t')}) AS w FROM benchmark), t AS (SELECT item_id, unnest(w) AS t FROM w),
c AS (SELECT item_id, t, 1 + ln(count(*)) AS tf FROM t GROUP BY 1, 2), f AS (
  SELECT item_id, 't:' || t AS f, tf AS x FROM c
  UNION ALL SELECT item_id, 'g:' || substr('<' || t || '>', i, n), tf * 0.22 FROM (SELECT item_id, t, tf, n, unnest(range(1, length(t) + 2 - n + 2)) AS i FROM c, (SELECT unnest([3, 4, 5]) AS n))
  UNION ALL SELECT item_id, 'b:' || w[i] || '_' || w[i + 1], 0.6 FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM w)),
h AS (SELECT f, {_fnv('f')} % 768 AS bucket, CASE WHEN {_fnv("'s:' || f")} % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM (SELECT DISTINCT f FROM f))
SELECT item_id, CAST(bucket AS INT) AS bucket, round(sum(sign * x), 5) + 0.0 AS weight FROM f JOIN h USING (f) GROUP BY 1, 2""")
def r8_hashed_features(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return C.hashed_features(b, "item_id").select("item_id", "bucket", (F.round("weight", 5) + 0.0).alias("weight"))


@register(None)
def r8_embeddings(spark, sf_dir):
    e = C.embeddings(table(spark, sf_dir, "benchmark"), "item_id")
    n = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return e.select("item_id", F.size("embedding").alias("width"), F.round(n, 6).alias("norm"))


@register("""SELECT page_id, len(regexp_extract_all(html, '(?i)<script\\b|javascript:|vbscript:')) AS n FROM pages WHERE len(regexp_extract_all(html, '(?i)<script\\b|javascript:|vbscript:')) BETWEEN 1 AND 20""")
def r32_screen(spark, sf_dir):
    s = C.screen(table(spark, sf_dir, "pages"), "page_id", "html").filter("rule = 'script_or_macro'")
    return s.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT page_id, false AS quarantined FROM pages")
def r32_screen_cleaned(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))
    return C.screening_verdicts(p, C.screen(p, "page_id"), "page_id").select("page_id", "quarantined")


_PAGE = f"regexp_replace({_TEXT}, '^\\s+|\\s+$', '', 'g')"


@register(f"SELECT page_id AS version_id, CASE WHEN {_PAGE} = '' THEN 'needs_review' ELSE 'ready' END AS outcome FROM pages")
def r33_ingest(spark, sf_dir):
    """Pages to text, screening, structure, chunks, citation map and outcome in one job; d5_ingest_stream writes all its tables."""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("version_id"), F.col("html").alias("text"))
    return derived(page_table(files, F.lit("html")))["outcomes"]


@register("""SELECT DISTINCT version_id, '6.' || p_size || '.' || id AS reference FROM (SELECT p_partkey // 200 + 1 AS version_id, p_size, p_partkey % 900 AS id FROM part)""")
def c1_requirement_set(spark, sf_dir):
    from attestry.operators.compliance import requirement_set

    requirements, _ = requirement_set(C.sections(_coded(spark, sf_dir)))
    return requirements.select("version_id", "reference")


@register("""SELECT p_partkey, 1 AS lines, round(p_size / 100.0, 6) AS x FROM part""")
def r20_highlight_boxes(spark, sf_dir):
    def word(t, x):
        return F.struct(F.lit(t).alias("t"), x.cast("double").alias("x"), F.lit(0.1).alias("y"), F.lit(0.05).alias("w"), F.lit(0.02).alias("h"))

    x = F.col("p_size") / 100.0
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("exit stair").alias("excerpt"), F.array(word("the", F.lit(0.0)), word("Exit", x), word("stair.", x + 0.06)).alias("word_boxes"))
    boxes = V.highlight_boxes(rows)
    return boxes.select("p_partkey", F.size("boxes").alias("lines"), F.round(F.col("boxes")[0]["x"], 6).alias("x"))
