"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, sized, tasks_for

HEAVY = 4096  # a node with more than this share of all edges is met by a broadcast; there are at most 2 * HEAVY


def with_least(edges: DataFrame, rows: int) -> DataFrame:
    """edges (a, b) with m, the smallest of a and its neighbours.

    Minima are aggregated before they are shuffled. A node with over rows / HEAVY neighbours is looked
    up in a broadcast table, at most HEAVY rows for so many edges, so that no task meets all of them.
    """
    n = tasks_for(edges.sparkSession, rows)
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")).coalesce(n)
    heavy = least.filter(F.col("n") > rows / HEAVY).select("a", F.col("m").alias("top"))
    known = edges.join(F.broadcast(heavy), "a", "left")
    light = sized(known.filter("top IS NULL").drop("top"), rows, "a").join(sized(least.select("a", "m"), rows, "a"), "a")
    return light.unionByName(known.filter("top IS NOT NULL").withColumnRenamed("top", "m"))


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable.

    Alternating large and small stars: each round hangs a node's larger neighbours on its smallest
    neighbour, then its smaller ones. Rounds grow with the logarithm of the longest path. Each round
    is written to the shared folder. Self loops and repeated edges are allowed; an empty table gives
    an empty table.
    """
    scratch = Scratch(edges.sparkSession)
    kind = edges.schema["a"].dataType
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a IS NOT NULL")
    pairs = scratch.save(pairs, "round-0")

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(pairs)
    for n in range(1, most_rounds + 1):
        rows = before[0]
        both = pairs.filter("a <> b").unionByName(pairs.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(sized(both, rows, "a", "b").dropDuplicates(["a", "b"]), 2 * rows)
        large = large.filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(sized(large, rows, "a", "b").dropDuplicates(["a", "b"]), f"large-{n}")
        # a hangs on fewer and fewer nodes, so no node is heavy here for long
        small = with_least(large, rows)
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        own = small.unionByName(large.groupBy("a").agg(F.min("b").alias("b")).coalesce(tasks_for(edges.sparkSession, rows)))
        small = scratch.save(sized(own.filter("a <> b"), rows, "a", "b").dropDuplicates(["a", "b"]), f"round-{n}")
        scratch.drop(f"round-{n - 1}")
        scratch.drop(f"large-{n}")
        after, pairs = state(small), small
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("b").cast(kind).alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
