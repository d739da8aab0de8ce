"""Strongly connected components, and the graph between them.

Nodes that can't lie on a cycle are trimmed first, round by round: those without an edge in, or without one out, among the
edges that are left. What remains is coloured forward: every node takes the largest name that reaches it. A colour's root is
the node of that name, and what reaches the root inside its colour is the root's component; it is taken out, and the rest is
trimmed and coloured anew. Rounds end as stored tables; the driver sees counts.

Edge cases: null ends are ignored; loops and parallel edges change nothing; without edges there are no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwarden.tables import is_empty, small, stored


def _trimmed(steps: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The ``(at, to)`` steps between nodes that have both a way in and a way out, as far as trimming gets, and their number."""
    while n:
        into, out = steps.select(F.col("to").alias("at")).distinct(), steps.select(F.col("at").alias("to")).distinct()
        kept = stored(steps.join(small(into, n), "at", "left_semi").join(small(out, n), "to", "left_semi").select("at", "to"), "trimmed")
        left = kept.count()
        if left == n:
            break
        steps, n = kept, left
    return steps, n


def _coloured(steps: DataFrame) -> DataFrame:
    """``(node, colour)``: the largest name among a node and all that reach it."""
    nodes = steps.select(F.col("at").alias("node")).union(steps.select("to")).distinct()
    colours = stored(nodes.withColumn("colour", F.col("node")), "colours")
    fresh = colours
    while True:
        offers = fresh.join(steps, F.col("node") == F.col("at")).groupBy(F.col("to").alias("node")).agg(F.max("colour").alias("offer"))
        better = stored(offers.join(colours, "node").where("offer > colour").select("node", "offer"), "colours")
        n = better.count()
        if not n:
            return colours
        colours = stored(colours.join(small(better, n), "node", "left").select("node", F.coalesce("offer", "colour").alias("colour")), "colours")
        fresh = better.select("node", F.col("offer").alias("colour"))


def _rooted(steps: DataFrame, colours: DataFrame) -> DataFrame:
    """``(node, component)``: the nodes that reach their colour's root inside the colour; the component's name is its colour."""
    inside = steps.join(colours.withColumnRenamed("node", "at"), "at").join(colours.select(F.col("node").alias("to"), F.col("colour").alias("other")), "to").where("colour = other")
    inside = stored(inside.select("at", "to", "colour"), "inside")
    found = stored(colours.where("node = colour").select("node", F.col("colour").alias("component")), "rooted")
    fresh = found
    while not is_empty(fresh):
        behind = inside.join(fresh.withColumnRenamed("node", "to"), "to").where("colour = component").select(F.col("at").alias("node"), "component").distinct()
        fresh = stored(behind.join(found.select("node"), "node", "left_anti"), "rooted")
        found = stored(found.unionByName(fresh), "rooted")
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``edges(source, target)`` that share a component with another; stored.

    A component is named by its largest node. All other nodes are components of their own.
    """
    steps = stored(edges.select(F.col("source").alias("at"), F.col("target").alias("to")).where("at is not null and to is not null and at != to").distinct(), "steps")
    n, found = steps.count(), None
    while True:
        steps, n = _trimmed(steps, n)
        if not n:
            break
        rooted = _rooted(steps, _coloured(steps))
        shared = rooted.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        own = rooted.join(shared, "component", "left_semi").select("node", "component")
        found = own if found is None else found.unionByName(own)
        gone = rooted.select("node")
        steps = stored(steps.join(gone.withColumnRenamed("node", "at"), "at", "left_anti").join(gone.withColumnRenamed("node", "to"), "to", "left_anti").select("at", "to"), "steps")
        n = steps.count()
    if found is None:
        found = steps.select(F.col("at").alias("node"), F.col("to").alias("component")).where("false")
    return stored(found, "components")


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``(source, target)``: the distinct edges between components, stored; it has no cycle."""
    named = edges.select("source", "target").where("source is not null and target is not null")
    for end in ("source", "target"):
        own = components.select(F.col("node").alias(end), "component")
        named = named.join(small(own), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    return stored(named.where("source != target").select("source", "target").distinct(), "condensed")
