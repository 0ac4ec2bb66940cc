"""Hybrid retrieval for many questions at once: three channels within each question's scope, to the picked passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from attestry.operators import postings as P
from attestry.operators import retrieve as R
from attestry.operators import scan as S
from attestry.sources.store import Store
from attestry.streaming.sink import saved, scratch

CHANNEL, PICKED, PER_SOURCE = 40, 12, 4  # fixed values: hits of a channel, passages picked, of one source
FUSED = 100_000  # fused rows that are broadcast; more meet the passages by a shuffle
STAGES = ("lexical", "vector", "locator", "fused", "kept", "picked")


def hybrid(
    queries: DataFrame, passages: DataFrame, store: Store | None, as_of: Column, scope: DataFrame | None = None, vectors: DataFrame | None = None,
    key: str = "chunk_id", channel: int = CHANNEL, limit: int = PICKED, per_source: int = PER_SOURCE, telemetry: dict | None = None,
) -> DataFrame:
    """The picked passages of each query with their fused and reranked scores and ``picked``, their place.

    queries (query_id, text) may have ``expanded``, the text that the locator channel and the reranking
    read, and ``embedding`` and ``model`` for the vector channel over vectors (key, source_id, embedding,
    model). ``scope`` (query_id, source_id) holds what each query may see: every channel's limit counts
    passages in scope only, and a query without scope gets nothing. passages carry key, source_id,
    version_id, page_number, ordinal, content, chapter, section, clause, kind and effective_date; the
    store is the index of their contents; without one, which needs queries without scope, the lexical
    channel reads the passages through. What is reranked is written once, so that removing
    duplicates does not run the channels again. ``telemetry`` gets the number of rows of each stage.
    """
    spark, folder = queries.sparkSession, scratch(queries.sparkSession)
    asked = queries.withColumn("expanded", F.col("expanded") if "expanded" in queries.columns else F.col("text"))
    observed = {stage: Observation(f"{stage}-{folder[-8:]}") for stage in STAGES}

    def seen(stage: str, rows: DataFrame) -> DataFrame:
        return rows.observe(observed[stage], F.count(F.lit(1)).alias("rows")) if telemetry is not None else rows

    if store is None and scope is not None:
        raise ValueError("a scope needs the index")
    if store is None:
        words = S.scanned_lexical(asked, passages, channel, key)
    else:
        words = P.stored_lexical(asked, store, channel, key, sources=passages.select(key, "source_id"), scope=scope)
    channels = {"lexical": seen("lexical", words)}
    if vectors is not None:
        channels["vector"] = seen("vector", R.vector(asked, vectors, channel, key, scope=scope))
    named = asked.select("query_id", F.col("expanded").alias("text"))
    channels["locator"] = seen("locator", R.locator(named, passages, channel, key, scope=scope))
    fused = saved(seen("fused", R.fuse(channels, key)), f"{folder}/fused")
    told = passages.select(key, "content", "version_id", "source_id", "page_number", "chapter", "section", "clause", "kind", "effective_date")
    rows = told.join(R.small(fused, FUSED), key).join(asked.select("query_id", F.col("expanded").alias("query_text")), "query_id")
    ranked = saved(R.rerank(rows, as_of, key=key), f"{folder}/ranked")
    kept = seen("kept", R.drop_near_duplicates(ranked, key=key))
    picked = saved(seen("picked", R.diversify(kept, limit, per_source, key=key)), f"{folder}/picked")
    if telemetry is not None:
        telemetry |= {stage: observed[stage].get["rows"] for stage in STAGES if stage != "vector" or vectors is not None}
    return spark.read.schema(picked.schema).parquet(f"{folder}/picked")
