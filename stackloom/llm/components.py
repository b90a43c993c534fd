"""Connected components on Spark, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds after which something must be wrong: each about halves the longest path.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component): for each node of edges (a, b), which may be of any
    orderable kind, the smallest node that it can reach. Loops and repeated
    edges do no harm; nodes without an edge to another node get no row.

    Each round links the larger neighbours of a node to the smallest of its
    neighbourhood, then the smaller ones. Joins and sums are on node ids, so a
    node with many neighbours is summed up before the shuffle, and skewed joins
    can be split."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    seen = None
    for _ in range(max_rounds):
        if links.isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        # large star: every larger neighbour of x is linked to the smallest of x and its neighbours
        both = links.union(links.select("v", "u")).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u, are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), "m").union(least.select(F.col("u").alias("a"), "m"))
        links = materialize(small.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct(), "links")
        # a forest of stars maps onto itself: every node has one link and no head has any
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen is not None and tuple(state) == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
