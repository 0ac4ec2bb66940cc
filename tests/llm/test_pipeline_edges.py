"""Every pipeline stage on odd rows: nulls, empty and very long texts, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

STAGES = dict(corpus_pipeline.STAGES)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["river", "stone", "walks", "under", "quiet", "green", "lamps", "seven", "over", "table"]) + str(rng.randrange(400)) for _ in range(n))


def rows():
    shared = "\n".join(prose(100 + i, 8) for i in range(5))
    out = [
        (1, prose(1, 80), "en", "web", 1), (2, prose(2, 80), "en", "web", 1), (3, None, "en", "web", None), (4, "", "en", "web", 0), (5, " \n\t ", None, None, 4),
        (None, prose(6, 70), "en", "web", 1), (None, None, None, None, None), (7, prose(7, 60) + "\n" + shared, "en", "web", 1),
        (8, prose(8, 60) + "\n" + shared, "en", "web", 1), (9, prose(1, 80), "fr", "web", 1), (1, prose(1, 80), "en", "web", 1),
        (10, "\n".join(prose(1000 + i, 9) for i in range(3000)), "en", "long", 1), (11, "x" * 50_000, "en", "long", 1),
        (12, "\n" * 5000, "en", "long", 1), (13, prose(20, 30_000), "en", "long", 1), (14, "𝄞 é 漢字 " * 40, "en", "web", 1),
    ]
    return out + [(50 + i, prose(1, 79) + f" end{i}", "en", "web", 1) for i in range(6)]  # near copies


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    labels = [(1, 1, 0), (2, 1, 0), (7, 1, 0), (11, 0, 0), (14, 0, 1), (None, 1, 0), (8, None, None), (1, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, prose(8, 60)), (2, None), (3, ""), (None, prose(9, 40)), (4, "two words"), (1, prose(8, 60))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


CLASHING = ("k", "t", "text_", "digest", "place", "start", "stop", "size", "key", "line", "_row", "class_id", "score", "item_id", "quality")


@pytest.mark.parametrize("stage", list(STAGES))
def test_stage_keeps_its_contract_on_odd_rows(spark, folder, stage):
    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    plain = [tuple(r) for r in STAGES[stage](spark, docs, folder).collect()]
    wide = docs.withColumns({c: F.lit(c) for c in CLASHING})
    out = STAGES[stage](spark, wide, folder)
    own = [c for c in STAGES[stage](spark, docs, folder).columns]
    if stage == "packing":
        assert sorted(map(str, (tuple(r[c] for c in own[:5]) for r in out.collect()))) == sorted(str(r[:5]) for r in plain)
        assert len({(r[0], r[1]) for r in plain if r[0] is not None}) >= len({r[0] for r in rows()}) - 1
        return
    assert out.columns == wide.columns
    got = [tuple(r[c] for c in docs.columns) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain))
    known = {r[0] for r in rows()}
    assert {r[0] for r in plain} <= known
    if stage == "line_dedup":
        assert len(plain) == len(rows())
        assert sum(prose(100, 8) in (r[1] or "") for r in plain) == 1
    if stage == "near_dedup":
        assert sum((r[1] or "").startswith(prose(1, 40)) for r in plain) == 1
        assert {2, 7, 10, 13} <= {r[0] for r in plain}
    if stage == "decontamination":
        assert 8 not in {r[0] for r in plain} and {1, 2, 7, 10, 13} <= {r[0] for r in plain}


@pytest.mark.parametrize("stage", list(STAGES))
def test_stage_on_empty_tables(spark, folder, bare, stage):
    empty = spark.createDataFrame([], DOCS)
    assert STAGES[stage](spark, empty, folder).count() == 0
    assert STAGES[stage](spark, empty, bare).count() == 0
    few = spark.createDataFrame(rows()[:9], DOCS)
    assert STAGES[stage](spark, few, bare).count() > 0
