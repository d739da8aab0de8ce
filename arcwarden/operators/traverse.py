"""Reachability and least-weight paths by frontier joins.

Each hop is one join of the frontier with the edges, a look at what is known of the nodes met, and a stored table; all starts go
together as (start, node) pairs. Paths are exact under the hop cap: costs are kept by number of hops, and only nodes whose
cost the last hop improved go on. Equal costs go to the smaller edge id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.tables import is_empty, small, stored


def traversable_edges(edges: DataFrame, nodes: DataFrame | None = None, conditional: bool = True, attack_only: bool = True, active_only: bool = False) -> DataFrame:
    """Edges that a walk may take. ``active_only``: the library's rule; else only CONDITIONAL ones may be left out.

    ``attack_only`` drops structural edges, and edges that leave service nodes (of ``nodes``). Weights of 0 or less count as 1.
    """
    kept = edges.where("state = 'ACTIVE'") if active_only and not conditional else edges
    kept = kept if conditional else kept.where("state is null or state != 'CONDITIONAL'")
    if attack_only:
        kept = kept.where("relationship_kind is null or relationship_kind != 'STRUCTURAL'")
        if nodes is not None:
            services = nodes.where("node_type = 'Service'").select(F.col("node_id").alias("source"))
            kept = kept.join(services, "source", "left_anti").select(*edges.columns)
    return kept.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0)))


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct ``(at, to)`` steps."""
    a, b = ("source", "target") if direction == "forward" else ("target", "source")
    return edges.select(F.col(a).alias("at"), F.col(b).alias("to")).distinct()


def bfs_pairs(edges: DataFrame, starts: DataFrame, max_hops: int | None = None, direction: str = "forward") -> DataFrame:
    """``(start, node, depth)`` of all nodes within ``max_hops`` of each row of ``starts(node)``, itself included."""
    steps = stored(_steps(edges, direction), "steps")
    seen = stored(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct(), "seen")
    frontier, rounds, hop = seen, [seen], 0
    while (max_hops is None or hop < max_hops) and not is_empty(frontier):
        hop += 1
        found = frontier.join(steps, F.col("node") == F.col("at")).select("start", F.col("to").alias("node")).distinct()
        for old in rounds:
            found = found.join(old.select("start", "node"), ["start", "node"], "left_anti")
        frontier = stored(found.select("start", "node", F.lit(hop).alias("depth")), "frontier")
        rounds.append(frontier)
        if len(rounds) > 6:  # few tables to look into, however many hops
            rounds = [stored(_union(rounds), "seen")]
    return _union(rounds)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def bfs_depth(edges: DataFrame, starts: DataFrame, max_hops: int | None = None, direction: str = "forward") -> DataFrame:
    """``(node, depth)``: hops from the nearest start."""
    steps = stored(_steps(edges, direction), "steps")
    seen = stored(starts.select("node", F.lit(0).alias("depth")).distinct(), "seen")
    frontier, rounds, hop = seen, [seen], 0
    while (max_hops is None or hop < max_hops) and not is_empty(frontier):
        hop += 1
        found = small(frontier).join(steps, F.col("node") == F.col("at")).select(F.col("to").alias("node")).distinct()
        for old in rounds:
            found = found.join(old.select("node"), "node", "left_anti")
        frontier = stored(found.select("node", F.lit(hop).alias("depth")), "frontier")
        rounds.append(frontier)
        if len(rounds) > 6:
            rounds = [stored(_union(rounds), "seen")]
    return _union(rounds)


def bfs_within(edges: DataFrame, starts: DataFrame, max_hops: int | None = None, direction: str = "forward") -> DataFrame:
    """Nodes within reach of any start, starts included."""
    return bfs_depth(edges, starts, max_hops, direction).select("node")


def reaches(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that can be reached from the start, without it."""
    return bfs_depth(edges, start).where("depth > 0").select("node")


def reached_by(edges: DataFrame, target: DataFrame) -> DataFrame:
    """Nodes from which the target can be reached, without it."""
    return bfs_depth(edges, target, direction="backward").where("depth > 0").select("node")


class _Labels:
    """Labels found so far, as runs that are only added to; while a run isn't larger than the next one, both become one."""

    def __init__(self, first: DataFrame, n: int):
        self.runs = [(first, n)]

    def rows(self) -> DataFrame:
        return _union([run for run, _ in self.runs])

    def known(self, offers: DataFrame, n: int, keys: list[str], label: Column) -> DataFrame:
        """The least label, ``known``, of each of the ``n`` offers' keys that has one."""
        return self.rows().join(small(offers.select(*keys), n), keys, "left_semi").groupBy(*keys).agg(F.min(label).alias("known"))

    def add(self, run: DataFrame, n: int) -> None:
        self.runs.append((run, n))
        while len(self.runs) > 1 and self.runs[-2][1] <= self.runs[-1][1]:
            (a, m), (b, n) = self.runs[-2:]
            self.runs[-2:] = [(stored(a.unionByName(b), "labels"), m + n)]


def relax(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``(start, node, hops, cost, edge_id, prev)``: each improvement of a node's cost, by hops; starts have cost 0.

    A hop's offers meet the labels of their own nodes only, and what is better is added to the tree; nothing is written anew.
    """
    steps = stored(edges.select("edge_id", F.col("source").alias("at"), F.col("target").alias("to"), "weight"), "steps")
    now = stored(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("edge_id"), F.lit(None).cast("string").alias("prev")).distinct(), "relax")
    n, hop, keys = now.count(), 0, ["start", "node"]
    tree = _Labels(now, n)
    while n and (max_hops is None or hop < max_hops):
        hop += 1
        met = steps.join(small(now.select("start", "node", "cost"), n), F.col("node") == F.col("at"))
        best = met.groupBy("start", F.col("to").alias("node")).agg(F.min(F.struct((F.col("cost") + F.col("weight")).alias("cost"), steps["edge_id"].alias("edge_id"), F.col("at").alias("prev"))).alias("o"))
        offers = stored(best, "offers")
        offered = offers.count()
        better = offers.join(small(tree.known(offers, offered, keys, F.col("cost")), offered), keys, "left").where(F.col("known").isNull() | (F.col("o.cost") < F.col("known")))
        now = stored(better.select("start", "node", F.lit(hop).alias("hops"), "o.cost", "o.edge_id", "o.prev"), "relax")
        n = now.count()
        tree.add(now, n)
    return tree.rows()


def nearest_target(edges: DataFrame, targets: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``(node, target, cost, hops)``: each node's nearest target within ``max_hops``, ties to the smaller target.

    One backward search from all targets: labels are (cost, target), and a node hands on its least one only.
    """
    steps = stored(edges.select(F.col("source").alias("at"), F.col("target").alias("to"), "weight"), "steps")
    now = stored(targets.select("node", F.col("node").alias("target"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops")).where("node is not null").distinct(), "nearest")
    n, hop, label = now.count(), 0, F.struct("cost", "target")
    found = _Labels(now, n)
    while n and (max_hops is None or hop < max_hops):
        hop += 1
        met = steps.join(small(now.select("node", "target", "cost"), n), F.col("node") == F.col("to"))
        offers = stored(met.groupBy(F.col("at").alias("node")).agg(F.min(F.struct((F.col("cost") + F.col("weight")).alias("cost"), "target")).alias("o")), "offers")
        offered = offers.count()
        better = offers.join(small(found.known(offers, offered, ["node"], label), offered), "node", "left").where(F.col("known").isNull() | (F.col("o") < F.col("known")))
        now = stored(better.select("node", "o.target", "o.cost", F.lit(hop).alias("hops")), "nearest")
        n = now.count()
        found.add(now, n)
    best = found.rows().groupBy("node").agg(F.min(F.struct("cost", "target", "hops")).alias("b"))
    return best.select("node", "b.target", "b.cost", "b.hops")


def least_costs(tree: DataFrame) -> DataFrame:
    """``(start, node, cost, hops)``: the least cost of each node, and the fewest hops at that cost."""
    return tree.groupBy("start", "node").agg(F.min(F.struct("cost", "hops")).alias("b")).select("start", "node", "b.cost", "b.hops")


def path_edges(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """``(start, end, at, edge_id)``: the edges of the paths to ``ends(start, node, hops)``, ``at`` counting from 1."""
    walk = stored(ends.select("start", F.col("node").alias("end"), "node", "hops"), "walk")
    out = []
    while not is_empty(walk.where("hops > 0")):
        step = walk.where("hops > 0").join(tree.select("start", "node", "hops", "edge_id", "prev"), ["start", "node", "hops"])
        step = stored(step.select("start", "end", "hops", "edge_id", "prev"), "walk")
        out.append(step.select("start", "end", F.col("hops").alias("at"), "edge_id"))
        # only nodes improved by the last hop went on, so the way before has exactly one hop less
        walk = step.select("start", "end", F.col("prev").alias("node"), (F.col("hops") - 1).alias("hops"))
    if not out:
        return walk.select("start", "end", F.col("hops").alias("at"), F.lit("").alias("edge_id")).where("false")
    return _union(out)


def shortest_path(edges: DataFrame, start: DataFrame, target: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``(start, node, cost, hops, edge_ids)`` of the least-weight path; no row if there is none, no edges if start is target."""
    tree = relax(edges, start, max_hops)
    ends = stored(least_costs(tree).join(target.select("node"), "node", "left_semi").select("start", "node", "cost", "hops"), "ends")
    chain = path_edges(tree, ends).groupBy("start", F.col("end").alias("node")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "edge_id"))), lambda x: x["edge_id"]).alias("edge_ids"))
    return ends.join(chain, ["start", "node"], "left").withColumn("edge_ids", F.coalesce("edge_ids", F.array().cast("array<string>")))


def shortest_bounded(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_hops: int = 12) -> DataFrame:
    """For each start the nearest target other than itself, ties to the smaller node: ``(start, node, cost, hops)``."""
    costs = least_costs(relax(edges, starts, max_hops)).join(small(targets.select("node").distinct()), "node", "left_semi").where("node != start")
    return costs.groupBy("start").agg(F.min(F.struct("cost", "node", "hops")).alias("b")).select("start", "b.node", "b.cost", "b.hops")


def shortest_to_each(edges: DataFrame, start: DataFrame, targets: DataFrame, max_hops: int = 12) -> DataFrame:
    """``(start, node, cost, hops)`` for every target within reach, from one tree."""
    return least_costs(relax(edges, start, max_hops)).join(small(targets.select("node").distinct()), "node", "left_semi").where("node != start")
