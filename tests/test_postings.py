"""The stored index against the exact search over all passages."""

from __future__ import annotations

import random

import pytest

from attestry.operators import postings as P
from attestry.operators import retrieve as R
from attestry.sources.store import Store


def passages(n=900, seed=1):
    rng = random.Random(seed)
    names = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = [rng.choice(names[: rng.choice([5, 20, 60])]) for _ in range(rng.randrange(0, 25))]
        if i % 37 == 0:
            words += ["rare"] * (1 + i % 5)
        rows.append((f"c{i:04d}", i // 10, " ".join(words) if i % 50 else None))
    return rows


QUERIES = [
    (1, "rare"), (2, "word1 word2 word3"), (3, 'word4 "word1 word2" word50'), (4, "absent"), (5, '"word3 word3"'), (6, "rare word59 word0"),
    (7, ""), (8, " ".join(f"word{i}" for i in range(30))), (9, "words1 word1"),
]


@pytest.mark.parametrize("block", [8, 512])
def test_stored_search_equals_exact_search(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "FIRST", 2)
    rows = passages()
    table = spark.createDataFrame(rows, "chunk_id string, doc long, content string")
    store = Store(spark, str(tmp_path / "index"), P.TABLES, 8)
    for batch in (0, 1, 1, 0):
        P.index_batch(store, table.filter(f"doc % 2 = {batch}"), batch, str(tmp_path / "w"), group="doc")
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    told: dict = {}
    got = P.stored_lexical(queries, store, 10, telemetry=told)
    want = R.lexical(queries, R.postings(table, "chunk_id", "content"), 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert told["read"] < told["blocks"] or block == 512
    some = table.filter("doc % 3 = 0")
    got = P.stored_lexical(queries, store, 10, within=some.select("chunk_id"))
    want = R.lexical(queries, R.postings(some, "chunk_id", "content"), 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_that_cannot_matter_and_other_buckets_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 10)
    rows = [(f"c{i:04d}", i // 10, "common " * (9 if i < 60 else 1) + f"own{i}") for i in range(1000)]
    store = Store(spark, str(tmp_path / "index"), P.TABLES, 16)
    P.index_batch(store, spark.createDataFrame(rows, "chunk_id string, doc long, content string"), 0, str(tmp_path / "w"), group="doc")
    told: dict = {}
    got = P.stored_lexical(spark.createDataFrame([(1, "common nowhere")], "query_id int, text string"), store, 5, telemetry=told)
    assert [r["chunk_id"] for r in got.orderBy("rank").collect()] == [f"c{i:04d}" for i in range(5)]
    assert told["blocks"] > 50 and told["read"] < 20 and told["buckets"] <= 2


def test_an_index_of_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"), P.TABLES)
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    assert P.stored_lexical(queries, store).collect() == []
    P.index_batch(store, spark.createDataFrame([], "chunk_id string, content string"), 0, str(tmp_path / "w"))
    assert P.stored_lexical(queries, store).collect() == []


def test_words_are_counted_in_their_row(spark):
    """No shuffle of words where keys stand once; rows of a key that stands twice are put together."""
    from attestry.operators import retrieve as R

    rows = [("a", "stairs exit stair the exit"), ("b", ""), ("c", None), ("d", "Exit 6.4")]
    single = R.postings(spark.createDataFrame(rows, "chunk_id string, text string"))
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    want = {("stair", "a", 2, (0, 2)), ("exit", "a", 2, (1, 4)), ("exit", "d", 1, (0,)), ("6.4", "d", 1, (1,))}
    assert {(r.term, r.chunk_id, r.tf, tuple(r.positions)) for r in single.collect()} == want
    twice = R.postings(spark.createDataFrame([*rows, ("d", "exit door exit")], "chunk_id string, text string"))
    assert ("exit", "d", 3, (0, 0, 2)) in {(r.term, r.chunk_id, r.tf, tuple(r.positions)) for r in twice.collect()}


def test_postings_of_a_block_lie_in_one_row_and_are_written_once(spark, tmp_path, monkeypatch):
    """Before, postings were written beside the index first, then shuffled into it, and shuffled again with every query."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(P, "BLOCK", 10)
    rows = [(f"c{i:03d}", i // 7, f"Exits of the stair {i % 5} stairs") for i in range(70)]
    store = Store(spark, str(tmp_path / "index"), P.TABLES)
    P.index_batch(store, spark.createDataFrame(rows, "chunk_id string, doc long, content string").coalesce(1), 3, str(tmp_path / "w"), group="doc")
    assert not (tmp_path / "w").exists()
    held = {r.block: r.postings for r in store.read("postings").collect()}
    assert len(held) == 5 and all([p.term for p in x] == sorted(p.term for p in x) for x in held.values())
    first = {(p.term, p.chunk_id): (p.tf, p.positions) for p in held[min(held)]}
    assert len(first) == 28 and first["stair", "c000"] == (2, [3, 5]) and first["exit", "c013"] == (1, [0])
    assert P.block_starts(9, pa.array([1, 1, 1, 1, 1, 1, 1, 1, 2]), 2).tolist() == [0, 8]
    assert P.block_starts(10, pa.array([1] * 9 + [2]), 2).tolist() == [0, 8]
    assert P.block_starts(5, None, 2).tolist() == [0, 2, 4] and not len(P.block_starts(0, None, 2)) and isinstance(P.block_starts(0, None, 2), np.ndarray)
