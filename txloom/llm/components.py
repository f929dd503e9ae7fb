"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle

MAX_ROUNDS = 60


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (v, smallest of u and its v)."""
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return pairs.join(lowest, F.col("u") == F.col("_u")).select("u", "v", "m")


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node of a link that joins two different nodes; component = smallest node.

    Each round is two joins on a written table, so a lost executor costs one
    round.  A node with many links is never gathered: its smallest neighbour is
    an aggregate, and adaptive execution splits its side of the join.  Null
    ends are no nodes.
    """
    a, b = F.col(left), F.col(right)
    edges = settle(links.where((a != b) & a.isNotNull() & b.isNotNull())
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        inner = edges.select(F.col("v").alias("_v")).distinct().join(edges, F.col("_v") == F.col("u"), "left_semi")
        twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if inner.isEmpty() and twice.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = _star(large)
        edges = settle(down.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))).distinct(), "links")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
