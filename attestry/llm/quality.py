"""Quality classifier by importance resampling.

Hashed n-gram generative models of target and raw text give each document the log importance weight
log p_target(x) - log p_raw(x). Raw text is a mixture: one model for every kind of labelled document
(clean, poor, toxic, both), weighted by its share; the target is the clean component. A component
is the set of hashed n-grams that a document holds; it departs from the target only in n-grams that
it clearly favours, so that a long clean document gathers no chance evidence. Documents are then
sampled by Gumbel top-k on these weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch

BUCKETS = 1 << 20  # of unigrams, and as many of longer n-grams
TRAINED_ON = 20_000  # labelled rows at most
TARGET, CELLS = 0, 4  # cells are 2 * toxic + (1 - quality): clean, poor, toxic, both
#: An n-gram tells a component apart if at least this share of its documents hold it (unigrams,
#: longer n-grams), at a count so many standard deviations and so many nats above its share.
SUPPORT, DEVIATIONS, NATS = (0.02, 0.15), 4.5, 1.2
MOST_NATS = 4.0  # of evidence from one n-gram
CAUTION = 2.0  # nats in favour of the target
TEMPERATURE = 0.1  # of the Gumbel noise; 0 is a plain cut
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHED = 150_000


class Features:
    """Bucket numbers of the unigrams, then of the longer n-grams, of a text.

    The longer ones are bigrams and, in eight buckets of their own, how much of the text is one
    word three times over.
    """

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > CACHED:
            known.clear()
        tokens = TOKEN.findall(text.lower())
        for t in tokens:
            if t not in known:
                known[t] = zlib.crc32(t.encode("utf-8", "replace"))
        own = np.fromiter((known[t] for t in tokens), np.uint64, len(tokens))
        pairs = own[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ own[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        n = np.uint64(self.buckets)
        again = own[:-1] == own[1:]
        triples = np.count_nonzero(again[1:] & again[:-1])
        level = [2 * self.buckets + min(7, int(-np.log2(triples / len(own))))] if triples else []
        found = np.concatenate([own % n, (pairs >> np.uint64(29)) % n + n, np.array(level, np.uint64)])
        return found.astype(np.int64)


def width(buckets: int) -> int:
    return 2 * buckets + 8


def training_rows(labels: DataFrame, key: str, at_most: int) -> DataFrame:
    """At most so many labelled keys, chosen by hash, with their cell; a key labelled twice takes the worst."""
    good = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    one = good.groupBy(F.col(key).alias("k")).agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    cell = (2 * F.when(F.col("x") > 0, 1).otherwise(0) + F.when(F.col("q") > 0, 0).otherwise(1)).alias("cell")
    return one.orderBy(F.xxhash64("k"), "k").limit(at_most).select("k", cell)


class Mixture:
    """Evidence in nats of each telling bucket for each component, and the components' log shares."""

    def __init__(self, buckets: np.ndarray, evidence: np.ndarray, documents: np.ndarray):
        self.buckets, self.evidence = buckets, evidence
        with np.errstate(divide="ignore"):
            self.share = np.log(documents / documents.sum())
        self.odds = self.share - CAUTION
        self.odds[TARGET] = self.share[TARGET]
        self.odds -= np.log(np.exp(self.odds).sum())

    def scorer(self, n: int):
        row = np.full(width(n), -1, np.int32)
        row[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)

        def log_weight(features: np.ndarray) -> float:
            """log p_target - log p_raw; at most -log of the target's share."""
            rows = row[features]
            own = self.odds + self.evidence[np.unique(rows[rows >= 0])].sum(0)
            top = own.max()
            return float(own[TARGET] - self.odds[TARGET] - top - np.log(np.exp(own - top).sum()))

        return log_weight


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, at_most: int, buckets: int) -> Mixture | None:
    """The mixture from at most ``at_most`` labelled documents; None where no target document is labelled."""
    chosen = training_rows(labels, key, at_most)
    # at most at_most rows of two numbers, by the limit above
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        totals, documents = np.zeros((CELLS, width(buckets)), np.int32), np.zeros(CELLS, np.int64)
        for batch in batches:
            for value, cell in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                totals[cell, np.unique(features(value.as_py() or ""))] += 1
                documents[cell] += 1
        at = np.flatnonzero(totals.any(0))
        columns = [np.append(at, -1), *(np.append(totals[c, at], documents[c]) for c in range(CELLS))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["bucket", *names])

    names = [f"n{c}" for c in range(CELLS)]
    schema = "bucket long, " + ", ".join(f"{n} long" for n in names)
    counted = rows.select("t", "cell").mapInArrow(count, schema).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))
    counted = Scratch(docs.sparkSession).save(counted, "counts")
    documents = counted.filter("bucket = -1").first()
    if documents is None or not documents["n0"]:
        return None
    of = np.array([documents[n] for n in names], float)
    total = sum(F.col(n) for n in names)
    telling, nats = [], []

    def ratio(c: int) -> Column:
        share = float(of[c] / of.sum())
        return F.log((F.col(names[c]) + share) / (total * share + share))

    for c in range(1, CELLS):
        share = float(of[c] / of.sum())
        enough = F.when(F.col("bucket") < buckets, SUPPORT[0]).otherwise(SUPPORT[1]) * float(of[c])
        above = (F.col(names[c]) - total * share) / F.sqrt(total * share * (1 - share) + 0.5)
        tells = (F.col(names[c]) > enough) & (above > DEVIATIONS) & (ratio(c) > NATS) if of[c] else F.lit(False)
        telling.append(tells)
        nats.append(F.when(tells, F.least(ratio(c) - ratio(TARGET), F.lit(MOST_NATS))).otherwise(0.0).alias(names[c]) if of[c] else F.lit(0.0).alias(names[c]))
    any_tells = telling[0] | telling[1] | telling[2]
    # by SUPPORT each component has at most its documents' mean number of n-grams / SUPPORT such rows
    model = counted.filter((F.col("bucket") >= 0) & any_tells).select("bucket", *nats).toPandas()
    evidence = np.zeros((len(model), CELLS))
    evidence[:, 1:] = model[names[1:]].to_numpy()
    return Mixture(model["bucket"].to_numpy(np.int64), evidence, of)


def weigh(docs: DataFrame, model: Mixture | None, key: str, text: str, buckets: int, more: list[str]) -> DataFrame:
    """key, log_weight (null for a text without tokens) and the columns in more."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, log_weight = Features(buckets), model.scorer(buckets) if model else lambda _: 0.0
        for batch in batches:
            weights = []
            for value in batch.column(0):
                found = features(value.as_py() or "")
                weights.append(log_weight(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(weights, pa.float64()), *batch.columns[1:]], ["log_weight", *batch.schema.names[1:]]
            )

    slim = docs.select(F.col(text).cast("string").alias("t"), F.col(key).alias("k"), *more)
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    return slim.mapInArrow(score, f"log_weight double, {rest}")


def gumbel(*key: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the key, the same in every run."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value by ever finer histograms; only bin counts leave the executors."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while True:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return low
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        inside = values.filter((F.col(column) >= low) & (F.col(column) <= high))
        counted = inside.groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column), F.max(column))
        for _, n, least, most in sorted(counted.collect(), reverse=True):  # at most `bins` rows
            if k <= n:
                break
            k -= n
        if least == most:
            return least
        low, high = least, most


def select_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", trained_on: int = TRAINED_ON,
    buckets: int = BUCKETS, temperature: float = TEMPERATURE, seed: int = 9,
) -> DataFrame:
    """The documents kept: key, log_weight and sample_key (the weight plus Gumbel noise).

    labels has the key, quality and toxic; rows with a null in any of them are not used. The models
    are fitted on at most ``trained_on`` labelled documents; every document is scored, whole. As many
    are kept as are more likely target than not. Documents whose keys tie at the last place are all
    kept, so repeated rows stand or fall together. A null, empty or token-free text is never kept.
    Without any labelled target document every document that has tokens is kept, with weight 0.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, key, text, trained_on, buckets)
    noise = temperature * gumbel(F.coalesce(F.col("k").cast("string"), F.lit("")), seed=seed)
    scored = weigh(docs, model, key, text, buckets, []).filter("log_weight IS NOT NULL")
    scored = Scratch(spark).save(scored.select("k", "log_weight", (F.col("log_weight") + noise).alias("sample_key")), "scored")
    out = scored.select(F.col("k").alias(key), "log_weight", "sample_key")
    if model is None:
        return out
    k = scored.filter(F.col("log_weight") + float(model.odds[TARGET]) >= float(np.log(0.5))).count()
    if not k:
        return out.limit(0)
    return out.filter(F.col("sample_key") >= kth_largest(scored, "sample_key", k))


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that select_quality keeps, all columns as they were."""
    kept = select_quality(docs, labels, key, **options).select(F.col(key).alias("_kept")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept"]), "left_semi").select(docs.columns)
