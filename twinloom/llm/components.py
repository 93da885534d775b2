"""Connected components of an edge table by alternating large and small stars.

Every step is an aggregation by node followed by a join with it, so a node with very many
neighbours is pre-aggregated and its join side can be split. Each step is written to the
shared folder, and the loop ends when a pair of steps leaves the edges as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm.shared import stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Each neighbour b of a node a is tied to the least of a and its neighbours.

    ``larger_only``: only neighbours above a are moved (large star); else pairs hold the
    neighbours below a, and a itself is moved too (small star).
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("__m"))
    least = least.select("a", F.least("a", "__m").alias("m"))
    joined = pairs.join(least, "a")
    if larger_only:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node."""
    edges = edges.filter(F.col("a") != F.col("b"))
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stage(_star(both, True).distinct())
        edges = stage(_star(large, False).distinct())
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
