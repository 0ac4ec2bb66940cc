"""A stored index of postings: written in batches, read by the asked terms, blocks that cannot matter skipped.

A row of ``postings`` holds all postings (term, key, tf, positions) of a block, some passages that lie
together in one batch, by term; so a task that has the row can score its passages, and neither writing
nor scoring shuffles postings. ``blocks`` has, for each term and block, the number of passages and the
largest tf, dealt into buckets by term, so that what a passage of a block can score at most is known
before its postings are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import scan as S
from attestry.operators.retrieve import small, top
from attestry.sources.store import Store
from attestry.streaming.sink import saved, scratch

TABLES = {"postings": "part", "blocks": "term"}
STREAM = "postings"
BLOCK = 512  # passages of a block, about
FIRST = 4  # blocks of a query that are read before the rest is judged
CHOSEN = 1_000_000  # blocks that are broadcast


def index_batch(store: Store, passages: DataFrame, batch: int, folder: str, key: str = "chunk_id", text: str = "content", group: str | None = None) -> bool:
    """Adds a batch of passages to the index in one commit; a batch that is in it already changes nothing.

    ``group``: a column of which equal values that follow each other stay in one block (of a document, say),
    which makes the bounds of blocks tighter. The same passage must not come in two batches.
    """
    if store.last_batch(STREAM) >= batch:
        return False
    more = [] if group is None else [group]
    kind = f"part long, block long, postings array<struct<term:string,{key}:{passages.schema[key].dataType.simpleString()},tf:long,positions:array<int>>>"
    size = BLOCK

    def written(batches: S.Batches) -> S.Batches:
        part, nth, numbers = batch << 20 | TaskContext.get().partitionId(), 0, {}
        known = S.Known(lambda stem: numbers.setdefault(stem, len(numbers)))
        for rows in batches:
            for low, high in S.pieces(rows.column(1)):
                if len(numbers) > S.REMEMBERED:
                    numbers.clear()
                    known.clear()
                own = rows.slice(low, high - low)
                starts = block_starts(len(own), own.column(2) if group else None, size)
                found = S.words_of(own.column(1).to_pylist(), known)
                lists = postings_of(own.column(0), starts, *found, list(numbers), key)
                ids = pa.array((part << 24) + nth + np.arange(len(starts)))
                nth += len(starts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), part)), ids, lists], names=["part", "block", "postings"])

    def most(new: dict[str, DataFrame]) -> DataFrame:
        rows = new["postings"].select("block", F.col("postings.term").alias("term"), F.col("postings.tf").alias("tf"))
        return rows.mapInArrow(largest, "term string, block long, most long, passages long")

    rows = S.whole(passages, key, text, *more).mapInArrow(written, kind)
    return store.commit(add={"postings": rows, "blocks": most}, stream=STREAM, batch=batch, placed=("postings",))


def block_starts(n: int, groups: pa.Array | None, size: int) -> np.ndarray:
    """Where the blocks of n passages begin; a group is cut only beyond four times the size."""
    if groups is None or not n:
        return np.arange(0, n, size)
    codes = pc.dictionary_encode(groups, null_encoding="encode").indices.to_numpy()
    change, out = np.append(np.flatnonzero(codes[1:] != codes[:-1]) + 1, n), [0]
    while out[-1] + size < n:
        end = int(change[np.searchsorted(change, out[-1] + size)])
        out.append(min(end, out[-1] + 4 * size))
    return np.array([x for x in out if x < n])


def postings_of(keys: pa.Array, starts: np.ndarray, p: np.ndarray, at: np.ndarray, t: np.ndarray, stems: list[str], key: str) -> pa.Array:
    """A list of postings for each block, by term and passage."""
    used, t = np.unique(t, return_inverse=True)
    names = pa.array([stems[i] for i in used.tolist()], pa.string())
    order = pc.sort_indices(names)
    rank = np.empty(len(used), np.int64)
    rank[order.to_numpy()] = np.arange(len(used))
    t, block = rank[t], np.searchsorted(starts, p, "right") - 1
    by = np.lexsort((at, p, t, block))
    p, at, t, block = p[by], at[by], t[by], block[by]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    ends = np.append(first, len(p))
    places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
    columns = [names.take(order).take(pa.array(t[first])), keys.take(pa.array(p[first])), pa.array(np.diff(ends), pa.int64()), places]
    held = pa.StructArray.from_arrays(columns, names=["term", key, "tf", "positions"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(block[first], np.arange(len(starts) + 1)), pa.int32()), held)


def largest(batches: S.Batches) -> S.Batches:
    """(term, block, most, passages) of blocks (block, terms, tfs)."""
    for rows in batches:
        term = rows.column(1)
        of = rows.column(0).take(pc.list_parent_indices(term))
        flat = pa.table({"term": pc.list_flatten(term), "block": of, "tf": pc.list_flatten(rows.column(2))})
        told = flat.group_by(["term", "block"]).aggregate([("tf", "max"), ("tf", "count")]).rename_columns(["term", "block", "most", "passages"])
        yield from told.to_batches()


def best_of_blocks(rows: DataFrame, asked: S.Asked, k: int, kind: str) -> DataFrame:
    """(query_id, key, matched_all, s) of blocks (terms, keys, tfs, positions): the k best of each query in each task."""

    def run(batches: S.Batches) -> S.Batches:
        best = None
        for batch in batches:
            terms, keys, tf = (pc.list_flatten(batch.column(i)) for i in range(3))
            best = best or S.Best(asked, k, keys.type)
            coded, named = keys.dictionary_encode(), terms.dictionary_encode()
            order = S.in_order(coded.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            numbers = np.array([asked.number(x) for x in named.dictionary.to_pylist()], np.int64)
            t = numbers[named.indices.to_numpy()] if len(numbers) else np.zeros(0, np.int64)
            own = np.flatnonzero(t >= 0)
            p = rank[coded.indices.to_numpy()[own]]
            by = np.argsort(p, kind="stable")
            own, p = own[by], p[by]
            places = None
            if asked.phrases:
                lists = pc.list_flatten(batch.column(3)).take(pa.array(own))
                each = pc.list_value_length(lists).to_numpy()
                places = S.by_number(np.repeat(p, each), pc.list_flatten(lists).to_numpy().astype(np.int64), np.repeat(t[own], each))
            best.add(coded.dictionary.take(order), p, t[own], tf.to_numpy()[own], places)
        if best:
            yield best.table()

    return rows.mapInArrow(run, kind)


def asked_parts(queries: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(query_id, n, part, term) of the queries' words; (query_id, n, part, len, off, term) of phrases, None if no query has one."""
    asked = queries.select("query_id", T.query_terms(F.col("text")).alias("terms"), T.query_phrases(F.col("text")).alias("phrases"))
    asked = asked.withColumn("n", F.size("terms") + F.size("phrases"))
    words = asked.select("query_id", "n", F.explode("terms").alias("part")).withColumn("term", T.stem(F.col("part")))
    quoted = asked.filter(F.size("phrases") > 0)
    if quoted.isEmpty():
        return words, None
    parts = quoted.select("query_id", "n", F.explode("phrases").alias("part")).withColumn("w", F.split("part", " "))
    parts = parts.select("query_id", "n", "part", F.size("w").alias("len"), F.posexplode("w").alias("off", "raw"))
    return words, parts.withColumn("term", T.stem(F.col("raw"))).drop("raw")


def stored_lexical(queries: DataFrame, store: Store, k: int = 40, key: str = "chunk_id", within: DataFrame | None = None, telemetry: dict | None = None,
                   sources: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, key, matched_all, score, rank), as retrieve.lexical() over all passages of the index.

    Only buckets of asked terms are read. For each query the FIRST blocks of the highest bound are
    scored; the k-th best sum there is a sum that k passages reach, so another block is read only if its
    bound reaches it or it has all parts of the query. ``within``: keys to which results are limited;
    ``scope``: (query_id, source_id) to which each query is limited, by ``sources`` (key, source_id).
    ``telemetry`` gets how many blocks the queries met and how many were read.
    """
    spark = queries.sparkSession
    words, phrases = asked_parts(queries)
    plan = S.asked_parts(queries)
    alone = within is None and scope is None and S.size_of(plan) <= S.PARTS  # then passages are scored where they lie
    terms = words.select("term") if phrases is None else words.select("term").unionByName(phrases.select("term"))
    buckets = sorted(r[0] for r in terms.select(store.bucket_of("blocks").alias("b")).distinct().collect())  # at most the store's buckets
    blocks, segments = store.read("blocks", buckets), store.read("postings")
    if blocks is None:
        kind = "query_id long, chunk_id string, matched_all boolean, score double, rank int"
        return spark.createDataFrame([], kind.replace("chunk_id", key))
    met = words.join(blocks, "term").select("query_id", "n", "part", "block", "most")
    if phrases is not None:
        held = phrases.join(blocks, "term").groupBy("query_id", "n", "part", "len", "block").agg(F.countDistinct("off").alias("got"), F.min("most").alias("most"))
        met = met.unionByName(held.filter("got = len").select("query_id", "n", "part", "block", "most"))
    bounds = met.groupBy("query_id", "block").agg(F.sum("most").alias("bound"), (F.countDistinct("part") == F.max("n")).alias("whole"))
    order = Window.partitionBy("query_id").orderBy(F.desc("whole"), F.desc("bound"), "block")
    bounds = bounds.withColumn("nth", F.row_number().over(order))

    def in_scope(hits: DataFrame) -> DataFrame:
        if scope is None:
            return hits
        return hits.join(sources.select(key, "source_id"), key).join(scope.select("query_id", "source_id"), ["query_id", "source_id"], "left_semi")

    def scored_alone(chosen: DataFrame) -> DataFrame:
        """The best passages of all queries in some blocks."""
        columns = [F.col(f"postings.{c}").alias(c) for c in ("term", key, "tf", *(["positions"] if asked.phrases else []))]
        rows = segments.join(small(chosen.select("block").distinct(), CHOSEN), "block", "left_semi").select(*columns)
        kind = S.kinds(queries, segments.selectExpr("inline(postings)"), key)
        return best_of_blocks(rows, asked, k, kind).select("query_id", F.col("key").alias(key), "s", "matched_all")

    def scored(chosen: DataFrame) -> DataFrame:
        """Sums of the passages of some (query_id, block)."""
        index = segments.join(chosen.select("block").distinct(), "block", "left_semi").selectExpr("block", "inline(postings)")
        wanted = words.join(blocks.select("term", "block"), "term").join(chosen, ["query_id", "block"])
        own = index if within is None else index.join(within.select(key), key, "left_semi")
        hits = wanted.join(own, ["term", "block"]).select("query_id", "n", key, "part", "tf")
        if phrases is not None:
            placed = phrases.join(blocks.select("term", "block"), "term").join(chosen, ["query_id", "block"]).join(own, ["term", "block"]).select(
                "query_id", "n", key, "part", "len", "off", F.explode("positions").alias("at")
            )
            runs = placed.groupBy("query_id", "n", key, "part", "len", (F.col("at") - F.col("off")).alias("start")).agg(F.countDistinct("off").alias("got"))
            hits = hits.unionByName(runs.filter("got = len").groupBy("query_id", "n", key, "part").agg(F.count(F.lit(1)).alias("tf")))
        return in_scope(hits).groupBy("query_id", key).agg(F.sum("tf").alias("s"), (F.countDistinct("part") == F.max("n")).alias("matched_all"))

    folder = scratch(spark)
    bounds = saved(bounds, f"{folder}/bounds")
    first = bounds.filter(F.col("nth") <= FIRST).select("query_id", "block")
    if alone:
        asked = S.Asked(plan.toArrow())
    sums = saved(scored_alone(first) if alone else scored(first), f"{folder}/sums")
    kth = top(sums, ["query_id"], [F.desc("s"), key], k).filter(F.col("rank") == k).select("query_id", F.col("s").alias("bar"))
    rest = bounds.filter(F.col("nth") > FIRST).join(kth, "query_id", "left")
    rest = rest.filter(F.col("bar").isNull() | F.col("whole") | (F.col("bound") >= F.col("bar"))).select("query_id", "block")
    if telemetry is not None:
        telemetry |= {"blocks": bounds.count(), "read": bounds.filter(F.col("nth") <= FIRST).count() + rest.count(), "buckets": len(buckets)}
    if alone:  # the first blocks have been scored for all queries
        rest = rest.join(first.select("block").distinct(), "block", "left_anti")
    if not rest.isEmpty():
        sums = sums.unionByName(scored_alone(rest) if alone else scored(rest))
    return S.ranked(sums, k, key)
