"""Near copies by the Jaccard similarity of five-word shingles.

Candidates come from SimHash and from MinHash. Of the SimHash of a set, WORDS times 64 bits, each
segment is indexed by its deletion variants (simhash.py), and sets that share a variant are compared
on 64 further bits; what such links connect is one group of candidates. Bits of a pair at similarity 0.8 differ with probability 0.15, so about three of
four such pairs share a variant; 0.9 gives 98 of 100. MinHash finds the rest: BANDS keys of ROWS
minima each. At similarity 0.8 a pair shares no key in (1 - 0.8^5)^32, some 3 of a million cases,
fewer above. Every candidate is verified on the whole shingle sets before it is linked, so no link is
below SIMILAR.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, salted, small_batches
from attestry.llm.components import connected_components
from attestry.llm.simhash import forest, majority, runs, variants

SEED, SHINGLE, SIMILAR = 42, 5, (4, 5)  # similarity 4 / 5 or more, in whole numbers
ROWS, BANDS = 5, 32
WORDS = 3  # of 64 bits, of which variants are taken; one more is compared
BITS = 16  # differing bits of that one, of sets that stay candidates: 99 % of pairs at SIMILAR, 4 of 100,000 others
CROWD = 1024  # sets under one variant that are compared by bits; larger groups are candidates whole
ROUNDS = 2  # of comparing a group with one member, before what is still apart is compared in cells
HALF = 512  # members of a block; a cell holds two blocks

_rng = np.random.default_rng(SEED)
XOR = _rng.integers(0, 1 << 64, ROWS * BANDS, np.uint64)
ODD = _rng.integers(0, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of five words; of a shorter text, of all its words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    k, digest = min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)} if words else set()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The BANDS keys of a shingle set; none for an empty one."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), 256):
        np.minimum(least, ((hashes[low : low + 256, None] ^ XOR) * ODD).min(0), out=least)
    rows = [xxhash.xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(rows, np.uint64).view(np.int64).tolist()


def fingerprints(hashes: np.ndarray) -> list[int]:
    """The SimHash of a shingle set: the 64 bits that are compared, then WORDS times 64 of remixed hashes."""
    found = [majority(hashes)]
    for add in XOR[:WORDS]:
        x = hashes ^ add
        for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(odd)
        found.append(majority(x ^ (x >> np.uint64(33))))
    return np.array(found, np.uint64).view(np.int64).tolist()


def signatures(rows: DataFrame) -> DataFrame:
    """(k, h, s, n, keys, fps) of rows (k, h, t): s names the shingle set, n is its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small_batches(batches):
            sets = [shingles(v.as_py() or "") for v in batch.column(2)]
            names = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))
            fps = pa.array([fingerprints(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names), pa.array([len(x) for x in sets], pa.int64()), keys, fps],
                ["k", "h", "s", "n", "keys", "fps"],
            )

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, h long, s long, n long, keys array<long>, fps array<long>")


def linked_under_variants(batches: Iterator[pa.RecordBatch], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (key, fp) sorted by key: edges that join the fps of a group as all links within ``bits`` would.

    A group of over ``most`` is joined whole: an edge only names candidates.
    """
    for keys, fps, whole in runs(batches, most):
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(first, len(keys)))
        pairs = first[(size == 2) & whole]
        hit = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= bits]
        left, right = [fps[hit]], [fps[hit + 1]]
        for at, n in zip(first[(size > 2) | (not whole)], size[(size > 2) | (not whole)], strict=True):
            if whole and n <= most:
                a, b = forest(fps[at : at + n], bits)
            else:
                a, b = np.full(n, keys[at]).view(np.uint64), fps[at : at + n]  # all hang on the key, which is no fp
            left.append(np.array(a, np.uint64))
            right.append(np.array(b, np.uint64))
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def variant_classes(own: DataFrame, scratch: Scratch, bits: int = BITS, most: int = CROWD) -> DataFrame:
    """(key, s, n): every set that is not empty, under the class of its links by deletion variants.

    Sets that share a variant and differ in at most ``bits`` of the 64 compared ones are in one class,
    and so are all that agree in these.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1024):
            words = np.asarray(batch.column(0).flatten()).view(np.uint64).reshape(-1, WORDS + 1)
            for number in range(WORDS):
                keys = variants(words[:, number + 1]) | np.uint64(number << 40)
                fps = np.broadcast_to(words[:, 0], keys.shape).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(fps.view(np.int64))], ["key", "fp"])

    some = own.filter("n > 0")
    rows = some.select("fps").distinct().mapInArrow(expand, "key long, fp long")
    dealt = rows.repartition("key").sortWithinPartitions("key")
    edges = scratch.save(dealt.mapInArrow(lambda batches: linked_under_variants(batches, bits, most), "a long, b long").distinct(), "variants")
    roots = connected_components(edges).select(F.col("node").alias("fp"), "root")
    sets = some.select(F.col("fps")[0].alias("fp"), "s", "n").distinct()
    return sets.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("key"), "s", "n")


def whole_sets(rows: DataFrame) -> DataFrame:
    """(s, x) of rows (s, t): the shingle set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [shingles(v.as_py() or "").view(np.int64) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["s", "x"])

    return rows.mapInArrow(run, "s long, x array<long>")


def sizes_fit(n: Column, m: Column) -> Column:
    """Whether sets of n and m members can reach SIMILAR."""
    return F.least(n, m) * SIMILAR[1] >= F.greatest(n, m) * SIMILAR[0]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets with Jaccard similarity SIMILAR or more."""
    left, right = sets.select(F.col("s").alias("a"), F.col("x").alias("xa")), sets.select(F.col("s").alias("b"), F.col("x").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    enough = both * sum(SIMILAR) >= (F.size("xa") + F.size("xb")) * SIMILAR[0]
    return pairs.join(left, "a").join(right, "b").filter(enough).select("a", "b")


def labels(edges: DataFrame) -> DataFrame:
    """(s, label): for every set with an edge another of its component, the smallest within two steps or so.

    Sets of one label are connected; that is all that the rounds of link_sets() need.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("b"))
    two = one.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return one.join(two, "b").select(F.col("a").alias("s"), F.col("c").alias("label"))


def cells_of(apart: DataFrame, half: int) -> DataFrame:
    """(key, cell, s, label): the members of each group dealt into cells so that any two of different labels meet.

    A group of up to two blocks is one cell. In a larger one the members of its most frequent label
    and the others form blocks apart; every block of the others meets every block of either kind, and
    a cell is two blocks. Members of the most frequent label do not meet each other: they are linked.
    """
    counted = apart.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "label")).alias("most")).select("key", "m", F.col("most.label").alias("often"), F.col("most.n").alias("n"))
    rows = salted(apart.select("key", "s", "label"), sizes, ["key"], F.xxhash64("s"))
    is_often = F.col("label") == F.col("often")
    own, others = F.ceil(F.col("n") / half), F.ceil((F.col("m") - F.col("n")) / half)  # blocks
    block = F.pmod(F.xxhash64("s", F.lit(1)), F.greatest(F.when(is_often, own).otherwise(others), F.lit(1)))

    def named(kind: int, i: Column, j: Column) -> Column:
        return F.lit(kind).cast("long") * (1 << 60) + i * (1 << 30) + j

    with_often = F.transform(F.sequence(F.lit(0).cast("long"), F.when(is_often, others).otherwise(own) - 1), lambda j: F.when(is_often, named(1, j, block)).otherwise(named(1, block, j)))
    with_others = F.transform(F.sequence(F.lit(0).cast("long"), others - 1), lambda j: named(2, F.least(block, j), F.greatest(block, j)))
    cells = F.when(F.col("m") <= 2 * half, F.array(F.lit(0).cast("long"))).when(is_often, with_often).otherwise(F.concat(with_often, with_others))
    return rows.select("key", F.explode(cells).alias("cell"), "s", "label")


def joined(s: np.ndarray, label: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Pairs of one cell that join its labels as all near pairs would; values are 31 bits of each shingle's hash.

    Equal bits of different shingles can only raise a similarity. Where it is two shingles above the
    least it is taken for certain, so that labels merge; what is nearer to the least is listed if its
    labels have not merged otherwise. All pairs are verified on the whole hashes afterwards.
    """
    g, part = len(s), np.unique(label, return_inverse=True)[1]
    codes = np.unique(values, return_inverse=True)[1]
    ends, own = np.cumsum(sizes), np.repeat(np.arange(g), sizes)
    marked, left, right, unsure = np.zeros(codes.max() + 1 if len(codes) else 1), [], [], []
    for i in range(g):
        apart = part != part[i]
        if not apart.any():
            break  # one label is left
        mine = codes[ends[i] - sizes[i] : ends[i]]
        marked[mine] = 1
        spare = np.bincount(own, marked[codes], g) * sum(SIMILAR) - (sizes + sizes[i]) * SIMILAR[0]
        marked[mine] = 0
        near = apart & (spare >= 0)
        for j in np.flatnonzero(near & (spare >= 2 * sum(SIMILAR))).tolist():
            if part[j] != part[i]:
                left.append(s[i])
                right.append(s[j])
                part[part == part[j]] = part[i]
        unsure += [(i, j) for j in np.flatnonzero(near & (part != part[i])).tolist()]
    for i, j in unsure:
        if part[i] != part[j]:
            left.append(s[i])
            right.append(s[j])
    return left, right


def compared(cells: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """(a, b): pairs of sets that join the labels in each cell; a cell is bounded, so a task may hold it whole."""
    short = sets.select("s", F.transform("x", lambda v: v.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("x"))
    tasks = max(cells.sparkSession.sparkContext.defaultParallelism, rows // 10_000)
    dealt = cells.join(short, "s").select("key", "cell", "s", "label", "x").repartition(tasks, "key", "cell").sortWithinPartitions("key", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            cell = pa.Table.from_batches(held).combine_chunks()
            x = cell["x"].combine_chunks()
            left, right = joined(
                cell["s"].to_numpy(), cell["label"].to_numpy(), np.diff(np.asarray(x.offsets)).astype(np.int64), np.asarray(x.flatten())
            )
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

        held, name = [], None
        for batch in small_batches(batches, 1024):
            keys, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (cell[1:] != cell[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if low == high:
                    continue
                if held and (keys[low], cell[low]) != name:
                    yield told(held)
                    held = []
                name = (keys[low], cell[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield told(held)

    pairs = dealt.mapInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_sets(index: DataFrame, sets: DataFrame, scratch: Scratch, rounds: int = ROUNDS, half: int = HALF) -> DataFrame:
    """(s, root) of the sets that have a near copy, from the index (key, s, n).

    Each round compares the members of a group with one of them and links what is near; members with
    one label need no further comparison. What is still apart after the last round is compared in
    cells: no candidate is left out, and no pair leaves a cell unless it joins two labels. Groups are
    aggregated to one row and met again in parts.
    """
    members, edges = index.withColumn("label", F.col("s")), None

    def still_apart(step: int) -> tuple[DataFrame, int]:
        group = members.groupBy("key").agg(
            F.min("label").alias("low"), F.max("label").alias("top"), F.min_by(F.struct("s", "n", "label"), F.xxhash64("s", F.lit(step))).alias("c"))
        apart = scratch.save(salted(members, group.filter("low < top").select("key", "c"), ["key"], F.xxhash64("s")), f"apart-{step}")
        return apart, apart.count()

    for step in range(rounds):
        apart, n = still_apart(step)
        if not n:
            break
        fits = (F.col("label") != F.col("c.label")) & sizes_fit(F.col("n"), F.col("c.n"))
        pairs = apart.filter(fits).select(F.least("s", "c.s").alias("a"), F.greatest("s", "c.s").alias("b")).distinct()
        new = scratch.save(verified(pairs, sets), f"edges-{step}")
        edges = new if edges is None else edges.unionByName(new)
        members = apart.select("key", "s", "n").join(scratch.save(labels(edges), f"labels-{step}"), "s", "left")
        members = members.select("key", "s", "n", F.coalesce("label", "s").alias("label"))
    else:
        apart, n = still_apart(rounds)
        if n:
            new = scratch.save(verified(scratch.save(compared(cells_of(apart, half), sets, n), "joined"), sets), "edges")
            edges = new if edges is None else edges.unionByName(new)
    if edges is None:
        return index.select("s", F.col("s").alias("root")).limit(0)
    return connected_components(edges).select(F.col("node").alias("s"), "root")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, h): key and text hash of the first row, by key and then hash, of every class of near copies.

    A class is what pairs of similarity SIMILAR or more connect. Texts of fewer than five words are
    near copies only of the same words; texts without words are one class. Null keys are not allowed.
    """
    scratch = Scratch(docs.sparkSession)
    t = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(t).alias("h"), t.alias("t"))
    own = scratch.save(signatures(rows), "signatures")
    lowest = own.groupBy("s").agg(F.min(F.struct("k", "h")).alias("low"))
    index = own.select("s", "n", "keys").dropDuplicates(["s"]).select(F.explode("keys").alias("key"), "s", "n")
    index = index.unionByName(scratch.save(variant_classes(own, scratch), "classes"))
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    index = scratch.save(index.join(shared, "key"), "index")
    wanted = lowest.join(index.select("s").distinct(), "s", "left_semi").select("s", "low.k", "low.h")
    sets = scratch.save(whole_sets(rows.join(wanted, ["k", "h"]).select("s", "t")).dropDuplicates(["s"]), "sets")
    roots = link_sets(index, sets, scratch)
    rooted = lowest.join(roots, "s", "left").select("low", F.coalesce("root", "s").alias("root"))
    return rooted.groupBy("root").agg(F.min("low").alias("low")).select("low.k", "low.h")
