"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (the larger ones, or the smaller ones) moved to its least neighbour."""
    if large:
        rows = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        rows = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    joined = rows.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("root").alias("b")).union(
            least.select("a", F.col("root").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the least node it can reach.

    Ends when no star changes; the number of rounds grows with the logarithm of the size.
    A node with a third of all edges is spread by the optimizer's skew handling: only a
    join, never an aggregate, follows its rows.
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "links")
    state = None
    while True:
        edges = written(_stars(_stars(edges, True), False), "links")
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == state:
            break
        state = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(edges.select("b", "b").distinct())
