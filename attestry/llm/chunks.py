"""Substring dedup: content-defined chunking with a gear rolling hash, chunks deduplicated by digest.

A cut falls where the gear hash of the last 16 bytes is the smallest within RADIUS bytes on either
side, so cuts depend on nearby bytes alone and insertions move them only nearby. A chunk reaches
over two cuts and shares one with the next chunk. Chunks are taken as equal if their 64-bit digests,
their numbers of code points and their numbers of words are.
Later occurrences are merged into spans, and spans of enough words are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import Scratch

RADIUS, LONGEST, SEED = 20, 160, 10
LEAST_WORDS = 20  # a passage loses less than two chunks at either end


def gear_table(seed: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(bytes([b]), seed) & 0xFFFF for b in range(256)], np.uint16)


def gear(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: the sum of the table's values of the last 16 bytes, each shifted by its age."""
    h = table[data]
    for back in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[back:] = h[:-back] << np.uint16(back)
        h = h + older
    return h


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of h[i : i + width] at each i, the ends padded by the largest value."""
    padded = np.concatenate([h, np.full(width, np.iinfo(h.dtype).max, h.dtype)])
    reach = 1
    while 2 * reach <= width:
        padded = np.minimum(padded[: len(padded) - reach], padded[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(padded[: len(h)], padded[rest : rest + len(h)])


def cuts(data: np.ndarray, table: np.ndarray, radius: int = RADIUS, longest: int = LONGEST) -> np.ndarray:
    """Ends of the variable parts of data, the last being its length."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    h = gear(data, table)
    right = least_of(h, radius + 1)
    left = least_of(h[::-1], radius + 1)[::-1]
    before = np.concatenate([np.full(1, np.iinfo(h.dtype).max, h.dtype), left[:-1]])  # of the radius + 1 bytes before
    ends = np.flatnonzero((h <= right) & (h < before)) + 1
    ends = ends[(ends > radius) & (ends < n - radius)]
    ends = np.append(ends, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() <= longest:
        return ends
    # a stretch without a cut is cut every `longest` bytes from its start
    extra = [np.arange(e - g + longest, e, longest) for e, g in zip(ends[gaps > longest], gaps[gaps > longest], strict=True)]
    return np.sort(np.concatenate([ends, *extra]))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def chunk_table(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(k, digest, place, words, again): the chunks of all texts, each digest once a document.

    place packs the code points of start and stop, words the numbers of words before them. again is
    the number of further occurrences in the document; those have rows of their own with again = -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table = gear_table(SEED)
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                whose, digests, places, words, again = [], [], [], [], []
                for at, value in enumerate(part.column(1)):
                    raw = (value.as_py() or "").encode("utf-8", "replace")
                    if not raw:
                        continue
                    data = np.frombuffer(raw, np.uint8)
                    ends = cuts(data, table, radius)
                    starts = np.concatenate([[0], ends[:-2]]) if len(ends) > 1 else np.zeros(1, np.int64)
                    stops = ends[1:] if len(ends) > 1 else ends
                    digest = np.array(
                        [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)],
                        np.uint64,
                    ).view(np.int64)
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    space = SPACE[data]
                    word = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
                    _, first, count = np.unique(digest, return_index=True, return_counts=True)
                    mark = np.full(len(digest), -1, np.int64)
                    mark[first] = count - 1
                    whose.append(np.full(len(digest), at))
                    digests.append(digest)
                    places.append((points[starts] << 32) | points[stops])
                    words.append((word[starts] << 32) | word[stops])
                    again.append(mark)
                if not whose:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.concatenate(whose))),
                     *(pa.array(np.concatenate(c)) for c in (digests, places, words, again))],
                    ["k", "digest", "place", "words", "again"],
                )

    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = slim.schema["k"].dataType.simpleString()
    return slim.mapInArrow(run, f"k {kind}, digest long, place long, words long, again long")


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, radius: int = RADIUS
) -> DataFrame:
    """One row per repeated span: key, span_start, span_stop, n_words, first_doc_id.

    A chunk is repeated if a document with a smaller key holds it, or an earlier place of the same
    document. Overlapping and touching repeated chunks form a span; spans of fewer than
    ``least_words`` words are left alone. Offsets are code points, the stop exclusive; first_doc_id
    is the smallest key that holds a chunk of the span. A passage loses less than two chunks at
    either end. Null and empty texts have no chunks. Rows with equal keys count as one document,
    rows with a null key are not compared. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    units = scratch.save(chunk_table(docs.filter(F.col(key).isNotNull()), key, text, radius), "chunks")

    def high(c: str) -> Column:
        return F.shiftright(c, 32)

    def low(c: str) -> Column:
        return F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))

    # the numbers of code points and words, which the row has already, part digests that meet by chance
    units = units.withColumn("size", F.shiftleft(low("place") - high("place"), 32).bitwiseOR(low("words") - high("words")))
    first = units.groupBy("digest", "size").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max("again").alias("more"))
    first = first.filter("first < last OR more > 0").select("digest", "size", "first")
    found = units.join(first.hint("shuffle_hash"), ["digest", "size"]).filter("k > first OR again < 0")

    parts = found.select(
        "k", "first", high("place").alias("start"), low("place").alias("stop"), high("words").alias("w0"), low("words").alias("w1")
    )
    in_order = Window.partitionBy("k").orderBy("start", "stop")
    so_far = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = parts.withColumn("open", F.when(F.col("start") <= so_far, 0).otherwise(1))
    numbered = opened.withColumn("span", F.sum("open").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("k", "span").agg(
        F.min("start").alias("span_start"), F.max("stop").alias("span_stop"),
        (F.max("w1") - F.min("w0")).alias("n_words"), F.min("first").alias("first_doc_id"),
    )
    return spans.filter(F.col("n_words") >= least_words).select(
        F.col("k").alias(key), "span_start", "span_stop", "n_words", "first_doc_id"
    )


def cut_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the spans of repeated_spans() taken out of the text; all other columns as they were."""
    cut = spans.groupBy(F.col(key).alias("_key")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("span_start").alias("a"), F.col("span_stop").alias("b")))).alias("_cut")
    )
    # the row as one column, so that no name of the input can meet one of ours
    rows, own = docs.select(F.struct(*docs.columns).alias("d")), f"d.`{text}`"
    kept = F.expr(
        f"""concat(array_join(transform(_cut, (s, i) -> substring({own},
              cast(if(i = 0, 0, _cut[i - 1].b) + 1 as int), cast(s.a - if(i = 0, 0, _cut[i - 1].b) as int))), ''),
            substring({own}, cast(_cut[size(_cut) - 1].b + 1 as int)))"""
    )
    joined = rows.join(cut, F.col("d")[key] == F.col("_key"), "left")
    whole = F.col("d")[text]
    columns = [F.when(F.col("_cut").isNull(), whole).otherwise(kept).alias(c) if c == text else F.col("d")[c].alias(c) for c in docs.columns]
    return joined.select(*columns)
