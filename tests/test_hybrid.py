"""Hybrid retrieval of all queries at once against each query alone over its scope."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from attestry.operators import postings as P
from attestry.operators import retrieve as R
from attestry.operators.hybrid import hybrid
from attestry.sources.store import Store


def test_hybrid_equals_each_query_alone_over_its_scope(spark, tmp_path):
    rng = random.Random(8)
    words = [f"term{i}" for i in range(25)]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(4, 14)))
        if i % 20 == 1:
            text = rows[-1][5]
        rows.append((f"c{i:03d}", i % 6, i % 12, i % 3, i + 1, text, "6", f"6.{i % 5}", f"6.{i % 5}.{i % 4}", [rng.gauss(0, 1) for _ in range(8)]))
    kind = "chunk_id string, source_id int, version_id int, page_number int, ordinal int, content string, chapter string, section string, clause string, embedding array<double>"
    table = spark.createDataFrame(rows, kind).withColumns({"kind": F.lit("paragraph"), "effective_date": F.lit(None).cast("date"), "model": F.lit("m")})
    asked = [(1, "term1 term2 clause 6.2.1", rows[5][9]), (2, "term3 section 6.4", rows[9][9]), (3, "term7", rows[11][9]), (4, "term1", rows[2][9])]
    queries = spark.createDataFrame(asked, "query_id int, text string, embedding array<double>").withColumn("model", F.lit("m"))
    scopes = {1: [0, 1, 2], 2: [3], 3: [0, 1, 2, 3, 4, 5]}  # the fourth sees nothing
    scope = spark.createDataFrame([(q, s) for q, ss in scopes.items() for s in ss], "query_id int, source_id int")
    store = Store(spark, str(tmp_path / "index"), P.TABLES, 4)
    P.index_batch(store, table, 0, str(tmp_path / "w"))
    now, told = F.lit("2024-01-01").cast("timestamp"), {}
    got = hybrid(queries, table, store, now, scope, table, channel=9, limit=6, per_source=2, telemetry=told)
    columns = ["query_id", "chunk_id", "picked"]
    got = {tuple(r) for r in got.select(*columns).collect()}
    want = set()
    for q, ss in scopes.items():
        one, seen = queries.filter(F.col("query_id") == q), table.filter(F.col("source_id").isin(ss))
        channels = {"lexical": R.lexical(one, R.postings(seen, "chunk_id", "content"), 9), "vector": R.vector(one, seen, 9), "locator": R.locator(one, seen, 9)}
        joined = R.fuse(channels).join(seen.drop("embedding", "model", "ordinal"), "chunk_id").join(one.select("query_id", F.col("text").alias("query_text")), "query_id")
        want |= {tuple(r) for r in R.diversify(R.drop_near_duplicates(R.rerank(joined, now)), 6, 2).select(*columns).collect()}
    assert got == want and len(got) > 10
    assert told["picked"] == len(got) and told["fused"] >= told["kept"] >= told["picked"] and told["vector"] == 27
