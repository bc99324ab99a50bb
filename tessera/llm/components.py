"""Connected components of an edge table, by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with ``least``: of u and all its v. The minimum merges map-side; a hot u's edges split in the join."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root) for every node with an edge; the root is the component's least node.

    Each round is two joins on written tables; the number of rounds grows with the logarithm of the longest path.
    """
    now = C.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("a"), F.col("least").alias("b"))
        large = C.written(large.filter("a <> b").distinct(), "edges")
        down = _with_least(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = down.select(F.col("v").alias("a"), F.col("least").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("least").alias("b")))
        now = C.written(small.filter("a <> b").distinct(), "edges")
    # every edge now leads from a node to its component's least node
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
