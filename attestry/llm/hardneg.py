"""Hard negatives by a vertical branch-and-bound scan of integer vectors.

A block of rows is held by dimension. An anchor reads the dimensions in descending magnitude of its own
components, STEP at a time; least and greatest components of the block bound what the unread dimensions
can still add, so candidates whose score cannot reach (or must pass) the wanted range leave the bitmap
early. Survivors have exact scores. Bounds only prune: the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import Scratch

STEP = 8  # dimensions read between two prunings
MOST = 5  # positives of an anchor, negatives of a positive
ROUND_BYTES = 16 << 20  # of anchors' vectors that one scan of the rows takes along
SCALE = 256
EXACT = 1 << 53  # integers below are exact as doubles
LIMIT = (1 << 63) - 1


def valid_rows(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(id, label, vector) of the rows that take part; every seventh id's label is moved on by one."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter("id IS NOT NULL AND c IS NOT NULL AND v IS NOT NULL").filter(finite)
    moved: Column = F.when(F.col("id") % 7 == 0, (F.col("c") + 1) % 10).otherwise(F.col("c"))
    return rows.select("id", moved.alias("label"), F.col("v").alias("vector"))


def quantised(vectors: pa.Array) -> np.ndarray:
    """floor(256 x) of vectors, a row per dimension; what a shorter vector lacks is 0."""
    offsets = np.asarray(vectors.offsets).astype(np.int64)
    flat = np.floor(SCALE * np.asarray(vectors.flatten(), np.float64))
    sizes = np.diff(offsets)
    out = np.zeros((int(sizes.max(initial=0)), len(sizes)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes), row] = flat
    return out


class Block:
    """Rows by dimension, sorted by label, with the least and greatest component of each dimension."""

    def __init__(self, batch: pa.RecordBatch, largest: float):
        labels = np.asarray(batch.column(1))
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels = np.asarray(batch.column(0))[order], labels[order]
        columns = quantised(batch.column(2))[:, order]
        self.whole = max(1, len(columns)) * np.abs(columns).max(initial=0) * largest < EXACT
        self.columns = columns if self.whole else np.vectorize(int, otypes=[object])(columns)
        self.bounds: dict[tuple[int, int], tuple] = {}

    def part(self, low: int, high: int):
        """Columns of some rows and their bounds."""
        if (low, high) not in self.bounds:
            own = self.columns[:, low:high]
            self.bounds[low, high] = own, own.min(axis=1), own.max(axis=1)
        return self.bounds[low, high]

    def of_label(self, label: int) -> tuple[int, int]:
        return tuple(int(np.searchsorted(self.labels, label, side)) for side in ("left", "right"))


def scan(part: tuple, anchor: np.ndarray, whole: bool, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Places among ``alive`` that ``keep`` leaves, and their exact scores.

    ``keep(least, greatest)`` gets the bounds of the scores so far and tells which stay.
    """
    columns, low, high = part
    own = anchor[: len(columns)]
    if not whole:
        own = np.vectorize(int, otypes=[object])(own)
    order = np.argsort(-np.abs(own), kind="stable")
    own = own[order]
    x, y = own * low[order], own * high[order]
    rest_high, rest_low = (np.append(np.cumsum(f(x, y)[::-1])[::-1], 0) for f in (np.maximum, np.minimum))
    score = np.zeros(len(alive), own.dtype)
    for at in range(0, len(order), STEP):
        dims = order[at : at + STEP]
        read = columns[dims] if len(alive) == columns.shape[1] else columns[dims[:, None], alive]
        score = score + own[at : at + STEP] @ read
        then = min(at + STEP, len(order))
        stays = keep(score + rest_low[then], score + rest_high[then])
        if not stays.all():
            alive, score = alive[stays], score[stays]
        if not len(alive):
            break
    return alive, score


def first(scores: np.ndarray, ids: np.ndarray, n: int = MOST) -> np.ndarray:
    return np.lexsort((ids, -scores))[:n]


class Best:
    """The first rows so far of some lists: higher scores first, then smaller ids."""

    def __init__(self):
        self.rows: dict = {}

    def least(self, key) -> float:
        """What a further row must reach at least."""
        held = self.rows.get(key)
        return held[0][-1] if held is not None and len(held[0]) == MOST else -float("inf")

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(ids):
            return
        if key in self.rows:
            scores, ids = np.append(self.rows[key][0], scores), np.append(self.rows[key][1], ids)
        at = first(scores, ids)
        self.rows[key] = scores[at], ids[at]

    def table(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows = [(*k, int(max(-LIMIT, min(LIMIT, s))), int(i)) for k, (scores, ids) in self.rows.items() for s, i in zip(scores, ids, strict=True)]
        for low in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[low : low + 10_000], strict=True)], schema=schema)


FOUND = pa.schema([(n, pa.int64()) for n in ("anchor", "slot", "score", "id")])
FOUND_SQL = "anchor long, slot long, score long, id long"


def positives(rows: DataFrame, anchors) -> DataFrame:
    """(anchor, slot, score, id): the first rows of each anchor's label in each task; anchors is a broadcast."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, labels, vectors, largest = anchors.value
        best = Best()
        for batch in batches:
            if not len(batch):
                continue
            block = Block(batch, largest)
            for number, own_id, label, vector in zip(numbers, ids, labels, vectors, strict=True):
                low, high = block.of_label(label)
                if low == high:
                    continue
                others = np.flatnonzero(block.ids[low:high] != own_id)
                key = (number, 0)

                def keep(least, greatest, key=key):
                    bar = best.least(key)
                    if len(least) > MOST:
                        bar = max(bar, np.partition(least, len(least) - MOST)[len(least) - MOST])
                    return np.asarray(greatest >= bar, bool)

                at, scores = scan(block.part(low, high), vector, block.whole, others, keep)
                best.add(key, scores, block.ids[low:high][at])
        yield from best.table(FOUND)

    return rows.mapInArrow(task, FOUND_SQL)


def negatives(rows: DataFrame, anchors, windows) -> DataFrame:
    """(anchor, slot, score, id): the first rows of other labels in each task for each window of an anchor's positives."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, labels, vectors, largest = anchors.value
        ranges = windows.value
        best = Best()
        for batch in batches:
            if not len(batch):
                continue
            block = Block(batch, largest)
            everything = np.arange(len(batch))
            for number, own_id, label, vector in zip(numbers, ids, labels, vectors, strict=True):
                own = ranges.get(number)
                low, high = block.of_label(label)
                others = np.append(everything[:low], everything[high:])
                others = others[block.ids[others] != own_id]
                if not own or not len(others):
                    continue
                bar = min(max(a, best.least((number, slot))) for slot, a, _ in own)
                ceiling = max(b for _, _, b in own)

                def keep(least, greatest, bar=bar, ceiling=ceiling):
                    return np.asarray((greatest >= bar) & (least <= ceiling), bool)

                at, scores = scan(block.part(0, len(batch)), vector, block.whole, others, keep)
                for slot, a, b in own:
                    inside = np.asarray((scores >= a) & (scores <= b), bool)
                    best.add((number, slot), scores[inside], block.ids[at[inside]])
        yield from best.table(FOUND)

    return rows.mapInArrow(task, FOUND_SQL)


def firsts(found: DataFrame) -> DataFrame:
    """The first rows of each (anchor, slot) over all tasks, with their rank from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST)


def rounds_of(anchors: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of the saved anchors' numbers (partition << 33 | place) that hold at most so many anchors each."""
    sizes = anchors.groupBy(F.shiftright("anchor", 33).alias("p")).count().orderBy("p").collect()
    return [((p << 33) + low, (p << 33) + min(low + most, n)) for p, n in sizes for low in range(0, n, most)]


def hard_negatives(
    vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 100, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose key is divisible by ``every``; positives are an anchor's first MOST other rows of
    its label, negatives the first MOST rows of other labels whose score lies within 0.8 to 1 times the
    positive's. Anchors are taken in rounds whose vectors have at most ``round_bytes``, which each task holds
    while it reads its rows once for positives and once for negatives; a task returns at most MOST rows for
    each anchor (and positive), so nothing is paired in a shuffle.

    Rows with a null key, label or vector or a component that is null or not finite take no part. Repeated
    rows take part once each; a row with the anchor's key is never its positive or negative, and a repeated
    anchor has its rows again. Components that a shorter vector lacks are 0. Scores are exact integers,
    clipped to 64 bits. An empty table, or an anchor without positives or negatives, gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = valid_rows(vectors, key, label, vector)
    anchors = rows.filter(F.col("id") % every == 0)
    anchors = scratch.save(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    width = anchors.agg(F.max(F.size("vector"))).first()[0] or 1
    most = max(1, round_bytes // (8 * width))
    n = anchors.count()
    if n:  # numbered anew over few partitions, so that rounds are full
        anchors = scratch.save(anchors.drop("anchor").repartition(-(-n // most)).withColumn("anchor", F.monotonically_increasing_id()), "numbered")
    results = None
    for number, (low, high) in enumerate(rounds_of(anchors, most)):
        own = anchors.filter((F.col("anchor") >= low) & (F.col("anchor") < high))
        held = own.select("anchor", "id", "label", "vector").toArrow()
        table = quantised(held["vector"].combine_chunks()).T
        taken = spark.sparkContext.broadcast((
            held["anchor"].to_pylist(), held["id"].to_pylist(), held["label"].to_pylist(), table, float(np.abs(table).max(initial=0))
        ))
        pairs = scratch.save(firsts(positives(rows, taken)).withColumn("slot", F.col("rank").cast("long")), f"positives-{number}")
        ranges: dict[int, list] = {}
        for anchor, slot, score in pairs.select("anchor", "slot", "score").toLocalIterator():
            if score >= 0:  # below 0 the window is empty
                ranges.setdefault(anchor, []).append((slot, -(-4 * score // 5), score))
        found = firsts(negatives(rows, taken, spark.sparkContext.broadcast(ranges)))
        found.write.parquet(scratch.path(f"negatives/round={number}"))
        results = found.schema
    if results is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = spark.read.schema(results).parquet(*[scratch.path(f"negatives/round={i}") for i in range(number + 1)])
    paired = spark.read.schema(pairs.schema).parquet(*[scratch.path(f"positives-{i}") for i in range(number + 1)])
    paired = paired.select("anchor", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return found.join(paired, ["anchor", "slot"]).join(named, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
