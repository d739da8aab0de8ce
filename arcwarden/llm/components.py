"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwarden.llm.common import maybe_broadcast, stored


def _least(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, stored: so the join with it deals a hub's edges out anew, or not at all."""
    return stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = _least(both).select("a", F.least("a", "m").alias("m"))
    return both.join(maybe_broadcast(least), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    hung = down.join(maybe_broadcast(least), "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is named by its smallest node.

    Rounds grow with the logarithm of the longest path; every round is a stored table of at most as many rows as edges.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    before = mark(now)
    while before[0]:
        now = stored(_small_star(_large_star(now)).where(F.col("a") != F.col("b")).distinct(), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components ``labels`` (stored) after further ``edges``: the rounds run over edges between components only."""
    moved = labels.where("node != component")
    between = edges.select("a", "b")
    for end in ("a", "b"):
        own = moved.select(F.col("node").alias(end), "component")
        between = between.join(maybe_broadcast(own), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    found = stored(components(between), "joined")
    up = found.where("node != component").select(F.col("node").alias("component"), F.col("component").alias("_up"))
    old = labels.join(maybe_broadcast(up), "component", "left").select("node", F.coalesce("_up", "component").alias("component"))
    return old.union(found.join(labels.select("node"), "node", "left_anti").select("node", "component"))
