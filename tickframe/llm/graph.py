"""Connected components by alternating stars, over edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.series import settle


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang every node's larger (or smaller) neighbours on the smallest one near it.

    ``edges`` has a > b. The minimum per node is a pre-aggregated sum and the join after it is
    one that a hot node's rows can be split over.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = edges.join(least, "a")
        moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            hung.select("a", F.col("m").alias("b")))
    moved = moved.where("a <> b")
    return moved if larger else moved.distinct()     # of the first kind there are no more than edges


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node only, which itself hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (a, b) reaches.

    Nulls and loops are left out; without edges the result is empty. Each round is a written
    table in the cluster's checkpoint folder. Ends when all nodes hang in stars.
    """
    edges = settle(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if _are_stars(edges):
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        edges = settle(_star(_star(edges, True), False))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
