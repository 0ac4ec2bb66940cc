"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments: of at most four differing bits, at least one
segment holds at most one. Each segment is indexed once for each of its bits with that bit taken
out, so two fingerprints whose segment differs in at most one bit share a key. Fingerprints that
share a key are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch
from attestry.llm.components import connected_components

SEED, SHINGLE, MOST_BITS = 42, 4, 4
#: Three segments suffice for up to five differing bits.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints under one key that are compared with each other; larger groups go to centres().
GROUP = 4096


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 14):
        part = hashes[low : low + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, seed: int = SEED, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles' XXH64; zero for a text without words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z alone, and x20 and x09-x0D
    n = len(words)
    if not n:
        return 0
    k = min(shingle, n)
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    stops = np.cumsum(sizes + 1) - 1
    starts, stops = (stops - sizes)[: n - k + 1].tolist(), stops[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(whole[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, fp): the key and the fingerprint's 64 bits as a long, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(v.as_py() or "") for v in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["k", "fp"])

    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return slim.mapInArrow(run, f"k {slim.schema['k'].dataType.simpleString()}, fp long")


def variants(fp: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint, one row per (segment, bit taken out)."""
    keys, number = [], 0
    for shift, width in SEGMENTS:
        segment = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            low = segment & np.uint64((1 << bit) - 1)
            high = (segment >> np.uint64(bit + 1)) << np.uint64(bit)
            keys.append((np.uint64(number) << np.uint64(32)) | high | low)
            number += 1
    return np.array(keys)


def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Of rows sorted by key: (keys, fingerprints, whole), groups cut only where they exceed ``most``.

    A part with whole set holds complete groups; without, it is a stretch of one group that is too large.
    """
    keys, fps, large = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        while len(keys):
            start = int(np.searchsorted(keys, keys[-1]))  # of the last group, which may go on
            if large is not None:
                stop = int(np.searchsorted(keys, large, "right"))
                if stop:
                    yield keys[:stop], fps[:stop], False
                    keys, fps = keys[stop:], fps[stop:]
                if len(keys):
                    large = None
                    continue
                break
            if start:
                yield keys[:start], fps[:start], True
                keys, fps = keys[start:], fps[start:]
            if len(keys) > most:
                large = keys[-1]
                continue
            break
    if len(keys):
        yield keys, fps, large is None


def near(fp: np.ndarray, one: np.uint64, bits: int) -> np.ndarray:
    return np.bitwise_count(fp ^ one) <= bits


def forest(fp: np.ndarray, bits: int) -> tuple[list, list]:
    """Edges that join the distinct fingerprints of one group as all its links would."""
    left, right, open_ = [], [], fp
    while len(open_) > 1:
        todo, open_ = [open_[0]], open_[1:]
        while todo and len(open_):
            one = todo.pop()
            hit = near(open_, one, bits)
            if hit.any():
                found = open_[hit]
                left += [one] * len(found)
                right += found.tolist()
                todo += list(found)
                open_ = open_[~hit]
    return left, right


def edges_of(batches: Iterator[pa.RecordBatch], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Edges of groups of up to ``most`` fingerprints; members of larger ones with a null partner."""
    for keys, fps, whole in runs(batches, most):
        left, right = [], []
        if not whole:
            fresh = np.unique(fps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fresh.view(np.int64)), pa.nulls(len(fresh), pa.int64())], ["a", "b"]
            )
            continue
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(first, len(keys)))
        for at, n in zip(first[size > most], size[size > most], strict=True):  # complete, but too large
            fresh = np.unique(fps[at : at + n])
            yield pa.RecordBatch.from_arrays(
                [pa.array(fresh.view(np.int64)), pa.nulls(len(fresh), pa.int64())], ["a", "b"]
            )
        pairs = first[size == 2]
        hit = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= bits
        left.append(fps[pairs[hit]])
        right.append(fps[pairs[hit] + 1])
        for at, n in zip(first[(size > 2) & (size <= most)], size[(size > 2) & (size <= most)], strict=True):
            a, b = forest(fps[at : at + n], bits)
            if a:
                left.append(np.array(a, np.uint64))
                right.append(np.array(b, np.uint64))
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def around(fp: int, bits: int) -> np.ndarray:
    """All 64-bit values within ``bits`` (0 to 2) of a fingerprint."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    masks = [np.zeros(1, np.uint64)]
    if bits > 0:
        masks.append(one)
    if bits > 1:
        i, j = np.triu_indices(64, 1)
        masks.append(one[i] | one[j])
    return np.concatenate(masks) ^ np.uint64(fp)


def centres(crowded: DataFrame, bits: int) -> DataFrame:
    """Edges among crowded fingerprints without comparing them in pairs.

    Two values differ in at most 2r bits exactly if some value lies within r bits of both, so all
    fingerprints around a common centre are linked: each is joined to the centre's smallest. Work
    and rows are in proportion to the number of fingerprints. bits must be even.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for low in range(0, len(fps), 32):
                part = fps[low : low + 32]
                all_ = np.concatenate([around(int(f), bits // 2) for f in part])
                own = np.repeat(part, len(all_) // len(part))
                yield pa.RecordBatch.from_arrays([pa.array(all_.view(np.int64)), pa.array(own.view(np.int64))], ["c", "a"])

    balls = crowded.select("a").mapInArrow(spread, "c long, a long")
    lowest = balls.groupBy("c").agg(F.min("a").alias("b"), F.max("a").alias("top")).filter("b < top").select("c", "b")
    return balls.join(lowest, "c").filter("a <> b").select("a", "b").distinct()


def link_fingerprints(fps: DataFrame, bits: int = MOST_BITS, group: int = GROUP) -> DataFrame:
    """(fp, root) for the distinct fingerprints that have a neighbour within ``bits``."""
    if not 0 <= bits <= 4 or bits % 2:
        raise ValueError("bits must be 0, 2 or 4")
    scratch = Scratch(fps.sparkSession)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for low in range(0, len(fp), 1024):
                part = fp[low : low + 1024]
                keys = variants(part)
                own = np.broadcast_to(part, keys.shape).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(own.view(np.int64))], ["key", "fp"]
                )

    index = fps.select("fp").distinct().mapInArrow(expand, "key long, fp long")
    sorted_ = index.repartition("key").sortWithinPartitions("key", "fp")
    found = sorted_.mapInArrow(lambda batches: edges_of(batches, bits, group), "a long, b long").distinct()
    found = scratch.save(found, "edges")
    edges = found.filter("b IS NOT NULL")
    crowded = found.filter("b IS NULL").select("a").distinct()
    if crowded.limit(1).count():
        edges = scratch.save(edges.unionByName(centres(crowded, bits)), "all-edges")
    return connected_components(edges).select(F.col("node").alias("fp"), "root")


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits) and component_id.

    component_id is the smallest key reachable over fingerprints that differ in at most four bits,
    the row's own included. Null, empty and word-free texts have fingerprint zero and are linked
    like any other. Repeated rows share a fingerprint, so a class. Rows with a null key get the
    class's smallest key, or null if it has none. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    own = scratch.save(fingerprints(docs, key, text), "fingerprints")
    lowest = own.groupBy("fp").agg(F.min("k").alias("low"))
    roots = link_fingerprints(own, group=group)
    rooted = lowest.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    classes = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return own.join(classes.select("fp", "component_id"), "fp").select(F.col("k").alias(key), hexed, "component_id")


def keep_one_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each class, the row with the smallest key stays.

    Near copies are those of nearcopies.py (five-word shingles, Jaccard 0.8 or more), not those of
    near_duplicate_classes; candidates come from the deletion variants above and from MinHash keys.
    All columns stay as they were. Rows that share a key are told apart by their text's hash; of
    identical ones, one stays. Rows with a null key stay.
    """
    from attestry.llm.nearcopies import representatives  # which needs the variants above

    kept = representatives(docs.filter(F.col(key).isNotNull()), key, text).select(F.col("k").alias("_k"), F.col("h").alias("_h"))
    # the row as one column, so that no name of the input can meet one of ours
    rows = docs.select(F.struct(*docs.columns).alias("d"), F.xxhash64(F.col(text).cast("string")).alias("_h"), F.col(key).alias("_k"))
    named = rows.join(kept, ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"]).select("d.*")
    return named.unionByName(docs.filter(F.col(key).isNull()))
