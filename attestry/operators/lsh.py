"""Nearest vectors by random projections: tables of sign buckets, several buckets asked, candidates scored exactly."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators.cells import TILE, Pairs, best_of_cells
from attestry.operators.retrieve import top, vector

TABLES, BITS, PROBES, SEED = 32, 10, 24, 7
NEAR = 7  # signs of the smallest margin that a further bucket may turn
EXACT_ROWS = 200_000  # up to so many vectors are all compared


def probed(margins: np.ndarray, probes: int) -> np.ndarray:
    """Masks of the signs to turn, a row per vector: the buckets that are the least margin away, the own one first."""
    near = np.argsort(np.abs(margins), axis=1, kind="stable")[:, :NEAR]
    cost = np.take_along_axis(margins, near, axis=1) ** 2
    sets = [s for n in range(4) for s in combinations(range(near.shape[1]), n)]
    total = np.stack([cost[:, list(s)].sum(axis=1) for s in sets], axis=1)
    masks = np.stack([(1 << near[:, list(s)]).sum(axis=1) if s else np.zeros(len(near), np.int64) for s in sets], axis=1)
    return np.take_along_axis(masks, np.argsort(total, axis=1, kind="stable")[:, :probes], axis=1)


def buckets_of(x: np.ndarray, tables: int, bits: int, probes: int = 1, seed: int = SEED) -> np.ndarray:
    """The buckets of each vector in each table, ``probes`` of them. A shorter vector counts as filled up with zeros."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * bits))  # the first rows do not depend on width
    out = np.empty((len(x), tables, probes), np.int32)
    for low in range(0, len(x), 1024):
        with np.errstate(all="ignore"):
            margins = (np.nan_to_num(x[low : low + 1024]) @ planes).reshape(-1, bits)
        own = (margins > 0) @ (1 << np.arange(bits))
        found = own[:, None] ^ (probed(margins, probes) if probes > 1 else 0)
        out[low : low + 1024] = found.reshape(-1, tables, probes)
    return out


def shared_buckets(asked: np.ndarray, offered: np.ndarray, buckets: int) -> Pairs:
    """For each bucket of each table, the queries that ask it and the vectors in it."""
    for t in range(asked.shape[1]):
        wants, has = asked[:, t].ravel(), offered[:, t, 0]
        by_query, by_vector, edges = np.argsort(wants, kind="stable"), np.argsort(has, kind="stable"), np.arange(buckets + 1)
        q, v = np.searchsorted(wants[by_query], edges), np.searchsorted(has[by_vector], edges)
        by_query //= asked.shape[2]
        for b in np.flatnonzero((np.diff(q) > 0) & (np.diff(v) > 0)).tolist():
            for low in range(q[b], q[b + 1], TILE[0]):
                for left in range(v[b], v[b + 1], TILE[1]):
                    yield by_query[low : min(low + TILE[0], q[b + 1])], by_vector[left : min(left + TILE[1], v[b + 1])]


def vector_lsh(
    queries: DataFrame, vectors: DataFrame, k: int = 40, key: str = "chunk_id", tables: int = TABLES, bits: int = BITS, probes: int = PROBES, seed: int = SEED
) -> DataFrame:
    """(query_id, key, score, rank): as retrieve.vector(), over the vectors that share one of the asked buckets.

    Each block of vectors has its own tables, of the same planes, so no pair of a query and a candidate
    is written anywhere. Equal vectors of a block are one candidate, whose first k keys then stand for
    it, so copies do not fill a bucket. Every vector is in the tables, and every candidate is scored by
    its exact cosine; what is approximate is only which vectors become candidates. More tables or probes
    raise recall and work.
    """

    def tiles(q: np.ndarray, v: np.ndarray):
        asked, offered = buckets_of(q, tables, bits, probes, seed), buckets_of(v, tables, bits, 1, seed)
        return lambda block: shared_buckets(asked, offered, 1 << bits)

    return top(best_of_cells(queries, vectors, k, key, tiles), ["query_id"], [F.desc("score"), key], k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 40, key: str = "chunk_id", exact_rows: int = EXACT_ROWS) -> DataFrame:
    """retrieve.vector() up to ``exact_rows`` vectors, vector_lsh() beyond."""
    few = vectors.select(key).limit(exact_rows + 1).count() <= exact_rows
    return vector(queries, vectors, k, key) if few else vector_lsh(queries, vectors, k, key)


def recall(found: DataFrame, exact: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: expected, found, recall."""
    hit = exact.select("query_id", key).join(found.select("query_id", key).withColumn("_f", F.lit(1)), ["query_id", key], "left")
    return hit.agg(F.count(F.lit(1)).alias("expected"), F.count("_f").alias("found"), F.try_divide(F.count("_f"), F.count(F.lit(1))).alias("recall"))
