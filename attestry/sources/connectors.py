"""Readers, triage, imports and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.functions import urls as U
from attestry.sources.store import Store

SUPPORTED = ["pdf", "docx", "xlsx", "pptx", "md", "txt", "html", "htm", "csv"]
MOST_BYTES, MOST_FILES = 100 * 1024 * 1024, 200

# Document type of a MIME type.
MIME_TYPES = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "text/markdown": "md", "text/plain": "txt", "text/html": "html", "text/csv": "csv",
}


def scan_workspace(table: DataFrame, workspace_id: int) -> DataFrame:
    """Live rows of one workspace; on a table partitioned by workspace_id this prunes partitions."""
    return table.filter((F.col("workspace_id") == workspace_id) & F.col("deleted_at").isNull())


def read_pages(raw: DataFrame, key: str, text: str, kind: Column) -> DataFrame:
    """(version_id, page_number, text): one page for each text, Markdown or HTML document."""
    body = F.when(kind == "html", T.html_text(F.col(text))).otherwise(T.normal_lines(F.col(text)))
    return raw.select(F.col(key).alias("version_id"), F.lit(1).alias("page_number"), body.alias("text"))


def read_sheets(spark: SparkSession, path: str, key: str = "sheet") -> DataFrame:
    """CSV files as sheet text: cells joined by ' | ', blank rows dropped, rows in file order."""
    rows = spark.read.text(path).select(F.input_file_name().alias(key), F.monotonically_increasing_id().alias("_at"), "value")
    return sheet_text(rows.select(key, "_at", F.split("value", ",").alias("cells")), key)


def sheet_text(rows: DataFrame, key: str, order: str = "_at") -> DataFrame:
    line = F.array_join(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")
    kept = rows.filter(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")).select(key, F.struct(F.col(order).alias("o"), line.alias("l")).alias("r"))
    return kept.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("r"))["l"], "\n").alias("text"))


def import_files(manifest: DataFrame, known: DataFrame, most_files: int = MOST_FILES) -> DataFrame:
    """manifest with its outcome: imported, present (content known), skipped (type, size) or left for the next run.

    Of repeated contents in one run the first is imported. The cap counts imports of a connector.
    """
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    have = known.select("sha256").distinct().withColumn("_known", F.lit(True))
    rows = manifest.join(have, "sha256", "left").withColumn("_bad", ~ext.isin(*SUPPORTED) | (F.col("size_bytes") > MOST_BYTES))
    again = F.row_number().over(Window.partitionBy("connector_id", "sha256", "_bad").orderBy("external_id")) > 1
    rows = rows.withColumn("_kind", F.when(F.col("_bad"), "skipped").when(F.col("_known") | again, "present").otherwise("imported"))
    nth = F.row_number().over(Window.partitionBy("connector_id", "_kind").orderBy("external_id"))
    outcome = F.when((F.col("_kind") == "imported") & (nth > most_files), "deferred").otherwise(F.col("_kind"))
    return rows.withColumn("outcome", outcome).drop("_known", "_bad", "_kind")


def import_websites(pages: DataFrame) -> DataFrame:
    """(page_id, title, final_url, document_type, origin): a source for each fetched page."""
    kind = F.when(F.lower(F.substring_index("url", "?", 1)).endswith(".pdf"), "pdf").otherwise("html")
    return pages.select("page_id", U.canonical_url(F.col("url")).alias("title"), F.col("url").alias("final_url"), kind.alias("document_type"), F.lit("website").alias("origin"))


# Leading bytes, in hex, of what is recognised or refused.
MAGIC = (
    ("4D5A", "executable"), ("7F454C46", "executable"), ("CAFEBABE", "executable"), ("D0CF11E0A1B11AE1", "legacy_office"),
    ("526172211A07", "rar"), ("377ABCAF271C", "7z"), ("25504446", "pdf"), ("504B0304", "zip"), ("89504E47", "png"), ("FFD8FF", "jpeg"),
)
EICAR = "EICAR-STANDARD-ANTIVIRUS-TEST-FILE"


def triage(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) with kind, accepted and reasons, by leading bytes, then extension."""
    head = F.hex(F.substring("content", 1, 16))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = None
    for mark, name in MAGIC:
        kind = F.when(head.startswith(mark), name) if kind is None else kind.when(head.startswith(mark), name)
    office = ext.isin("docx", "xlsx", "pptx")
    kind = F.coalesce(F.when(head.startswith("504B0304") & office, ext), kind, F.when(ext.isin(*SUPPORTED), ext), F.lit("unknown"))
    test = F.contains(F.hex(F.substring("content", 1, 128)), F.hex(F.lit(EICAR)))
    reasons = F.array_compact(F.array(
        F.when(kind == "executable", "executable content"), F.when(test, "antivirus test file"),
        F.when(kind == "legacy_office", "legacy office format"), F.when(kind.isin("rar", "7z"), "unsupported archive"),
        F.when(kind == "unknown", "unknown type"),
    ))
    return files.select("path", kind.alias("kind"), (F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"))


def document_type(mime: Column, name: Column) -> Column:
    """By MIME type, else by extension, else other."""
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.when(ext == "htm", "html").when(ext.isin(*SUPPORTED), ext)
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(mime, ";", 1))), by_name, F.lit("other"))


def robots_decision(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url_id, host, path) with allowed: the longest matching rule (host, prefix, allow) decides, allow wins ties.

    A url meets the different lengths of its host's rules, not the rules: of each length it can match
    one prefix, which is joined by equality.
    """
    sized = rules.withColumn("_n", F.length("prefix"))
    lengths = sized.select("host", "_n").distinct()
    offered = urls.select("url_id", "host", "path").join(lengths, "host").select("url_id", "host", "_n", F.expr("left(path, _n)").alias("prefix"))
    hits = offered.join(sized, ["host", "_n", "prefix"])
    best = hits.groupBy("url_id").agg(F.max_by("allow", F.struct("_n", "allow")).alias("a"))
    return urls.join(best, "url_id", "left").select("url_id", F.coalesce("a", F.lit(True)).alias("allowed"))


def allowed_hosts(urls: DataFrame, domains: DataFrame) -> DataFrame:
    """urls whose host is, or lies in, a listed domain; an equi-join on the host's suffixes."""
    wanted = domains.select(F.lower("domain").alias("_d")).distinct()
    hit = urls.select("url_id", F.explode(U.host_suffixes(F.col("host"))).alias("_d")).join(wanted, "_d", "left_semi").select("url_id").distinct()
    return urls.join(hit, "url_id", "left_semi")


def replace_versions(store: Store, table: str, rows: DataFrame, versions: DataFrame | None = None) -> None:
    """Replaces all rows of some versions in a table of a store; other versions of their buckets stay.

    ``versions`` names the versions whose rows go, those of ``rows`` if not given; a version without new
    rows is emptied. Running it again changes nothing.
    """
    store.commit(replace={table: (rows, versions if versions is not None else rows)})


def upsert(new: DataFrame, old: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last written; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def insert_absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new, one a key, whose key old has not."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def write_postings(postings: DataFrame, table: str, buckets: int) -> None:
    postings.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


def csv_field(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def write_csv(rows: DataFrame, path: str, most: int | None = None, order: list | None = None) -> None:
    """All fields quoted, quotes doubled; a limit belongs to the audit export alone."""
    out = rows.orderBy(*order).limit(most) if most else rows
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def csv_lines(rows: DataFrame) -> DataFrame:
    """The lines that write_csv() writes, as one column."""
    return rows.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in rows.columns]).alias("line"))


def evidence_columns(rows: DataFrame, sourced: list[str], flag: str) -> DataFrame:
    """rows without the columns in ``sourced`` where no row has a source."""
    some = rows.agg(F.max(F.col(flag).isNotNull())).first()[0]
    return rows if some else rows.drop(*sourced)
