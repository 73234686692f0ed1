"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

MAX_ROUNDS = 60


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest(both).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(
        F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller node; a node and its smaller neighbours point to the smallest."""
    least = _smallest(edges)
    moved = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("x"), "m")
    return moved.where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def _summary(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h), F.max("a")).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for every node but the roots themselves.

    edges has long columns a and b in any direction; repeats, loops and nulls do no harm. Each round is written
    to the shared folder, so lost executors cost one round at most; minima are combined before the shuffle and
    joins on a node with very many neighbours are left to the adaptive skew join.
    """
    tidy = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(tidy, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = _summary(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        if not state[0]:
            continue
        now = stored(_small_star(stored(_large_star(now), "large-star")), "small-star")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
