"""Connected components by alternating large and small stars, each a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have a < b, so a node's smaller neighbours are the a of its rows as b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))))
    return moved.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of edges(a, b), a < b. No edges: no rows.

    Every round is checkpointed to shared storage. It ends when each node has one edge, to its root, and no root has one.
    """
    edges = cut(edges.select("a", "b").distinct())
    while True:
        found = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        moved = cut(_small_star(_large_star(edges)))
        now = moved.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        edges = moved
        if found == now:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
