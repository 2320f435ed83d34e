"""Connected components of a large graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _lowest(edges: DataFrame) -> DataFrame:
    """The lowest neighbour of each u. Staged, so that the join that follows can be split where a hub is hot."""
    return stage(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs -> (node, root), root being the lowest node of the component.

    Nodes without an edge to another node are not in the result. Only two numbers a round reach the driver; the
    number of rounds grows with the logarithm of the largest diameter. A hub's edges are joined to one row, which
    adaptive execution splits.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, mark = None, _mark(now)
    while mark != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).select("u", F.least("u", "m").alias("m"))
        large = stage(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = _lowest(large)
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        before, mark = mark, _mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
