"""The best of many vectors for many queries: blocks of both meet in cells, and numpy scores a cell in tiles.

A cell holds a block of queries and a block of vectors, so a task's memory is bounded, and nothing
passes through the driver. Single-precision products choose what may be among the best; what they
cannot exclude, given their error, is scored as functions.numbers.cosine() does, term by term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 32_768  # queries, and vectors, of a cell at most (about)
KEPT = 1_000_000  # best vectors that a cell keeps for all its queries together
TILE, HITS = (1_024, 8_192), 200_000
Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """width -> (rows, their components, which are null and count as 0); null vectors are in none."""
    lists = column.combine_chunks()
    widths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    out = {}
    for width in np.unique(widths[widths >= 0]).tolist():
        rows = np.flatnonzero(widths == width)
        values = lists.take(pa.array(rows)).flatten()
        filled, absent = pc.fill_null(values, 0), pc.is_null(values)
        x, gone = (c.to_numpy(zero_copy_only=False).reshape(len(rows), width) for c in (filled, absent))
        out[width] = rows, x.astype(np.float64), gone
    return out


def in_turn(products: np.ndarray) -> np.ndarray:
    """Sum of each row, from its first to its last component."""
    total = np.zeros(len(products))
    for i in range(products.shape[1]):
        total += products[:, i]
    return total


class Best:
    """The k best vectors of each query so far; a smaller place wins a tie."""

    def __init__(self, queries: int, vectors: int, k: int):
        self.k, self.none = k, vectors
        self.score = np.full((queries, k), -np.inf)
        self.place = np.full((queries, k), vectors)

    def add(self, q: np.ndarray, v: np.ndarray, score: np.ndarray) -> None:
        own = np.unique(q)
        q = np.concatenate([q, np.repeat(own, self.k)])
        v = np.concatenate([v, self.place[own].ravel()])
        score = np.concatenate([score, self.score[own].ravel()])
        order = np.lexsort((v, -score, q))
        q, v, score = q[order], v[order], score[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
        q, v, score = q[new], v[new], score[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        fit = rank < self.k
        self.score[own], self.place[own] = -np.inf, self.none
        self.score[q[fit], rank[fit]], self.place[q[fit], rank[fit]] = score[fit], v[fit]


class Block:
    """Queries and vectors of one width each; ``vq`` and ``vv`` are their numbers in the cell."""

    def __init__(self, vq: np.ndarray, q: np.ndarray, no_q: np.ndarray, vv: np.ndarray, v: np.ndarray, no_v: np.ndarray, best: Best):
        width = min(q.shape[1], v.shape[1])
        self.absent = (no_q[:, :width], no_v[:, :width]) if no_q.any() or no_v.any() else None
        self.vq, self.vv, self.best = vq, vv, best
        self.q, self.v = np.ascontiguousarray(q[:, :width]), np.ascontiguousarray(v[:, :width])
        with np.errstate(all="ignore"):
            self.nq, self.nv = np.sqrt(in_turn(self.q * self.q)), np.sqrt(in_turn(self.v * self.v))
        self.uq, self.uv = self._units(self.q, self.nq), self._units(self.v, self.nv)
        self.error = 2 * (width + 8) * np.finfo(np.float32).eps
        self.least = np.full(len(q), -np.inf, np.float32)  # what cannot be among the best scores less
        self._refresh(np.arange(len(q)))

    @staticmethod
    def _units(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Vectors of length 1; those whose length single precision cannot tell are NaN, which excludes nothing."""
        with np.errstate(all="ignore"):
            unit = x / np.where(norm == 0, 1.0, norm)[:, None]
        unit[~np.isfinite(norm) | ((norm > 0) & (norm < 1e-140))] = np.nan
        unit[(norm == 0) & (x != 0).any(axis=1)] = np.nan
        return unit.astype(np.float32)

    def _refresh(self, q: np.ndarray) -> None:
        self.least[q] = self.best.score[self.vq[q], -1] - self.error

    def exact(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        for low in range(0, len(q), 16_384):
            a, b = q[low : low + 16_384], v[low : low + 16_384]
            with np.errstate(all="ignore"):
                norm, products = self.nq[a] * self.nv[b], self.q[a] * self.v[b]
                if self.absent:
                    products[self.absent[0][a] | self.absent[1][b]] = 0.0
                out[low : low + 16_384] = np.where(norm == 0, 0.0, in_turn(products) / norm)
        return np.where(np.isnan(out), np.inf, out)  # Spark's order: above all numbers

    def meet(self, tiles: Callable[[Block], Pairs]) -> None:
        """Scores the tiles (numbers of queries, of vectors)."""
        held, n = [], 0
        for q, v in tiles(self):
            with np.errstate(all="ignore"):
                s = self.uq[q] @ self.uv[v].T
            least = self.least[q]
            if s.shape[1] > 8 * self.best.k:
                some = s[:, : max(8 * self.best.k, 512)]
                floor = np.partition(np.nan_to_num(some, nan=-np.inf), -self.best.k, axis=1)[:, -self.best.k] - np.float32(self.error)
                least = np.maximum(least, floor)
            i, j = np.nonzero(~(s < least[:, None]))
            held.append((q[i], v[j]))
            n += len(i)
            if n > HITS:
                self._take(held)
                held, n = [], 0
        self._take(held)

    def _take(self, held: list) -> None:
        if held:
            q, v = (np.concatenate(x) for x in zip(*held, strict=True))
            for low in range(0, len(q), 5 * HITS):
                a, b = q[low : low + 5 * HITS], v[low : low + 5 * HITS]
                self.best.add(self.vq[a], self.vv[b], self.exact(a, b))
            self._refresh(np.unique(q))


def all_pairs(block: Block) -> Pairs:
    for i in range(0, len(block.q), TILE[0]):
        for j in range(0, len(block.v), TILE[1]):
            yield np.arange(i, min(i + TILE[0], len(block.q))), np.arange(j, min(j + TILE[1], len(block.v)))


def first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that have fewer than k equal ones before them."""
    if not x.shape[1]:
        return np.arange(min(k, len(x)))
    kind = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(kind, kind="stable")
    rank = np.arange(len(x)) - np.searchsorted(kind[order], kind[order])
    return np.sort(order[rank < k])


def best_in_cell(queries: pa.Table, vectors: pa.Table, k: int, tiles: Callable[[np.ndarray, np.ndarray], Callable[[Block], Pairs]]) -> pa.Table:
    """(query_id, key, score): the k best vectors of the cell for each of its queries."""
    vectors = vectors.take(pc.sort_indices(vectors["k"], null_placement="at_start"))
    best = Best(len(queries), len(vectors), k)
    told, offered = matrices(queries["v"]), matrices(vectors["v"])
    for vq, q, no_q in told.values():
        for vv, v, no_v in offered.values():
            few = np.arange(len(v)) if no_v.any() else first_copies(v, k)
            block = Block(vq, q, no_q, vv[few], v[few], no_v[few], best)
            block.meet(tiles(q, v[few]))
    q, at = np.nonzero(best.place < best.none)
    place, score = best.place[q, at], best.score[q, at]
    # a null vector has no score and comes last
    blank = np.flatnonzero(pc.is_null(vectors["v"]).to_numpy())[:k]
    null_query = pc.is_null(queries["v"]).to_numpy()
    for n in np.flatnonzero(best.place[:, -1] == best.none).tolist():
        more = np.arange(min(k, len(vectors))) if null_query[n] else blank
        q, place, score = np.append(q, np.full(len(more), n)), np.append(place, more), np.append(score, np.full(len(more), -np.inf))
    values = pa.array(np.where(score == np.inf, np.nan, score), mask=score == -np.inf)
    return pa.table([queries["query_id"].take(pa.array(q)), vectors["k"].take(pa.array(place)), values], names=["query_id", "k", "score"])


def best_of_cells(queries: DataFrame, vectors: DataFrame, k: int, key: str, tiles: Callable = lambda q, v: all_pairs, block: int = BLOCK) -> DataFrame:
    """(query_id, key, score): of each query the k best vectors of its model in every block of vectors, at least.

    ``tiles(queries, vectors)`` names what is compared in a cell, all pairs if left out.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n, m = queries.count(), vectors.count()
    across = -(-n // min(block, KEPT // k + 1)) or 1
    down = max(-(-m // block), min(2 * cores, m // 2_048), 1)

    def numbers(own: int, of: int, name: str):
        return F.pmod(F.xxhash64(name), F.lit(of)).cast("int") if own else F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    def dealt(rows: DataFrame, name: str, is_query: int) -> DataFrame:
        kept = rows.select("model", F.col(name).alias("query_id" if is_query else "k"), F.col("embedding").alias("v"))
        own = "query_id" if is_query else "k"
        kept = kept.withColumn("i", numbers(is_query, across, own)).withColumn("j", numbers(1 - is_query, down, own))
        return kept.repartition(max(across * down, cores), "model", "i", "j")

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, k {vectors.schema[key].dataType.simpleString()}, score double"
    pair = dealt(queries, "query_id", 1).groupBy("model", "i", "j").cogroup(dealt(vectors, key, 0).groupBy("model", "i", "j"))

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        return best_in_cell(q, v, k, tiles)

    return pair.applyInArrow(run, kinds).withColumnRenamed("k", key)
