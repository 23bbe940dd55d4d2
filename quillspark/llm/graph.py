"""Connected components by large and small stars; no part of the graph comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _is_flat(edges: DataFrame) -> bool:
    """Whether no node of edges (u, v) has two of them upwards, or is both a lower and an upper end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("low")), F.struct(F.col("v").alias("node"), F.lit(0).alias("low")))).alias("end"))
    seen = ends.groupBy("end.node").agg(F.sum("end.low").alias("lows"), F.min("end.low").alias("least"))
    return seen.where("lows > 1 or (lows = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """node and root, the least node of its component, for every node of ``edges`` (a, b) but the roots.

    Large stars link a node's larger neighbours to its least neighbour, small stars its smaller ones, until all are stars: then
    every node is linked to its root. Each round is written; a node with very many neighbours is the hot key of a join that
    Spark splits, and is summed up before it is shuffled.
    """
    now = ws.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    turn = 0
    while not _is_flat(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        turn += 1
        large = ws.save(large, f"{name}-{turn}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = ws.save(small, f"{name}-{turn}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def forest_roots(parents: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """node and root for every row of ``parents`` (a, b), of which each b has one, with a smaller a: the components of a forest.

    Each round links a node to its parent's parent, so the rounds are the logarithm of the longest chain.
    """
    now = ws.save(parents.select(F.col("b").alias("u"), F.col("a").alias("v")), f"{name}-0")
    turn = 0
    while not _is_flat(now):
        above = now.select(F.col("u").alias("v"), F.col("v").alias("w"))
        turn += 1
        now = ws.save(now.join(above, "v", "left").select("u", F.coalesce("w", "v").alias("v")), f"{name}-{turn}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
