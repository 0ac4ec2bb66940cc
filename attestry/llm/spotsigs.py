"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors."""

from __future__ import annotations

import hashlib
import json
import math
import re
from base64 import b64encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, let

#: Common words of English, French, German and Spanish; the anchors.
ANCHORS = frozenset(
    """a an and are as at be by for from has have in is it of on or that the this to was were will with
    au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une
    als auf aus bei das dem den der die ein eine einer im ist mit nicht sich sie sind und von zu zum
    al como con del el los las lo mas no para pero por se su sus una y""".split()
)
CHAIN = 2  # content words in a chain
LEAST = 0.0  # likeness under which edited_report() says 0: none, its values are exact
WORD = re.compile(r"\w+")


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit hashes of (anchor, following content words).

    A text without a single chain has its runs of chain + 1 words instead, or all its words if it is
    shorter; one without words has the hash of the text itself; the empty text has none.
    """
    import xxhash

    words = WORD.findall(text.lower())
    at = [i for i, w in enumerate(words) if w not in ANCHORS]
    content = [words[i] for i in at]
    digest, found = xxhash.xxh32_intdigest, set()
    n, nth = len(content), 0
    for i, w in enumerate(words):
        if w in ANCHORS:
            if nth + chain <= n:
                found.add(digest(" ".join([w, *content[nth : nth + chain]])))
        else:
            nth += 1
    if not found and words:
        step = min(chain + 1, len(words))
        found = {digest(" ".join(words[i : i + step])) for i in range(len(words) - step + 1)}
    elif not found and text:
        found = {digest(text.encode("utf-8", "replace"))}
    return np.sort(np.fromiter(found, np.uint32, len(found)))


def part_of(size: int, least: float) -> int:
    """The partition of a set of so many signatures: sizes within a factor 1 / least share one."""
    return math.floor(math.log(size) / -math.log(least)) if size else -2


def jaccard(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Jaccard of two sorted sets, 0 where it is under ``least``; 1 for two empty sets.

    With a ``least``, sets whose partitions are not the same or neighbours cannot reach it and are not
    compared; then the sizes themselves and the ranges of the signatures bound what two sets can share.
    """
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large or (least and abs(part_of(len(a), least) - part_of(len(b), least)) > 1):
        return 0.0
    if not small:
        return 0.0
    low, high = max(a[0], b[0]), min(a[-1], b[-1])
    a, b = a[np.searchsorted(a, low) : np.searchsorted(a, high, "right")], b[np.searchsorted(b, low) : np.searchsorted(b, high, "right")]
    if min(len(a), len(b)) * (1 + least) < least * (small + large):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    found = shared / (small + large - shared)
    return found if found >= least else 0.0


def encoded(signature: np.ndarray) -> str:
    return b64encode(signature.astype("<u4").tobytes()).decode()


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", chain: int = CHAIN) -> DataFrame:
    """(key, size, signatures): the number of signatures and the sorted array of them, one row per input row.

    Null texts count as empty and have no signatures. Repeated rows stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signatures(v.as_py() or "", chain).astype(np.int64) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                ["k", "size", "signatures"],
            )

    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = slim.schema["k"].dataType.simpleString()
    return slim.mapInArrow(run, f"k {kind}, size int, signatures array<long>").withColumnRenamed("k", key)


def similar_pairs(prints: DataFrame, key: str = "doc_id", least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of fingerprints with Jaccard of at least ``least``, and the membership.

    Equal fingerprints form a class, named by its smallest key, so copies are not expanded. Class
    sizes are partitioned geometrically, each partition holding sizes within a factor 1 / least, so
    partners lie in the same or the next partition. Candidates share one of the rarest signatures: a
    set of n elements has a partner only among sets that hold one of its first n - ceil(least * n) + 1
    signatures in order of frequency. Returns (a, b, jaccard) with a < b, and (key, class_id).
    """
    scratch = Scratch(prints.sparkSession)
    same = prints.withColumn("_same", F.xxhash64("size", "signatures"))
    lowest = same.groupBy("_same", "signatures").agg(F.min(key).alias("class_id"))
    member = same.join(lowest, ["_same", "signatures"]).select(key, "class_id")
    sets = scratch.save(
        lowest.select("class_id", "signatures", F.size("signatures").alias("n")).filter("n > 0"), "sets"
    )
    part = F.floor(F.log(F.col("n")) / float(-np.log(least))).cast("int")  # as part_of()
    words = sets.select("class_id", "n", F.explode("signatures").alias("s"))
    often = words.groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    ranked = words.join(often, "s").withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("f", "s")))
    prefix = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).filter("f > 1")
    index = scratch.save(prefix.select("s", "class_id", "n", part.alias("p")), "index")
    left = index.select("s", F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("p").alias("at"))
    right = index.select(
        "s", F.col("class_id").alias("b"), F.col("n").alias("nb"),
        F.explode(F.array(F.col("p"), F.col("p") + 1)).alias("at"),
    )
    near = (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    pairs = left.join(right, ["s", "at"]).filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = sets.select(F.col("class_id").alias("a"), F.col("signatures").alias("sa"))
    two = sets.select(F.col("class_id").alias("b"), F.col("signatures").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    scored = pairs.join(one, "a").join(two, "b").withColumn("jaccard", shared / (F.size("sa") + F.size("sb") - shared))
    return scored.filter(F.col("jaccard") >= least).select("a", "b", "jaccard"), member


def number_below(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are less than x, in about two square roots of their number of steps."""
    step = max(1, math.isqrt(len(bounds)))
    every = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    coarse = F.from_json(F.lit(json.dumps(bounds[step - 1 :: step])), "array<bigint>")

    def fine(block: Column) -> Column:
        return block * step + F.size(F.filter(F.slice(every, block * step + 1, step), lambda b: b < x))

    return let(F.size(F.filter(coarse, lambda b: b < x)), fine)


def edited_report(docs: DataFrame, key: str = "doc_id", text: str = "text", chain: int = CHAIN) -> DataFrame:
    """Each text's fingerprint against its edited text's and the next document's.

    The edited text has its last third replaced by as much of the start of the next document, in
    descending order of key (after the last, the first). Documents are dealt into ranges of keys; a
    range also gets the first document of the range below it, so texts move once and a task holds
    two of them at a time. Rows with equal keys follow each other by text; null keys come last. Keys
    are whole numbers. Likeness is the exact Jaccard; only sets whose ranges are apart go uncompared.
    """
    spark = docs.sparkSession
    shares = max(8, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    bounds = sorted({int(b) for b in slim.select("k").approxQuantile("k", [i / shares for i in range(1, shares)], 0.25 / shares)})
    share = F.when(F.col("k").isNull(), -1).otherwise(number_below(F.col("k"), bounds))
    ranged = slim.withColumn("share", share)
    tops = sorted(ranged.groupBy("share").agg(F.max("k").alias("top")).collect())  # at most `shares` + 1 rows
    into = [n for n, _ in tops[1:]] + [n for n, _ in tops[:1]]
    tops = spark.createDataFrame([(n, k, to) for (n, k), to in zip(tops, into, strict=True)], "share int, top long, to int")
    dealt = ranged.join(F.broadcast(tops), "share", "left")
    is_top = F.col("k").eqNullSafe(F.col("top"))
    goes = F.filter(
        F.array(F.struct(F.col("share").alias("s"), F.lit(0).alias("tail")),
                F.when(is_top, F.struct(F.col("to").alias("s"), F.lit(1).alias("tail")))),
        lambda x: x.isNotNull(),
    )
    dealt = dealt.select("k", "t", F.explode(goes).alias("g")).select("k", "t", "g.s", "g.tail")
    ordered = dealt.repartition("s").sortWithinPartitions("s", "tail", F.desc_nulls_last("k"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (share, key, text, signatures) of the row that waits for the next one
        done = -1_000_000  # the share whose tail has been used
        for batch in batches:
            rows = []
            for k, t, s, tail in zip(*(batch.column(i) for i in range(4)), strict=True):
                k, t, s, tail = k.as_py(), t.as_py(), s.as_py(), tail.as_py()
                if s == done:
                    continue
                own = signatures(t, chain)
                if held is not None and held[0] == s:
                    _, key_, text_, sign = held
                    third = len(text_) // 3
                    new = text_[: len(text_) - third] + t[:third]
                    changed = signatures(new, chain)
                    rows.append((
                        key_, len(text_), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), encoded(sign),
                        encoded(changed), jaccard(sign, changed), jaccard(sign, own),
                    ))
                held = None if tail else (s, k, t, own)
                done = s if tail else done
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    names = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = (
        "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return ordered.mapInArrow(run, schema).withColumnRenamed("k", key)
