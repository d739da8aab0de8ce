"""Assembly of the whole graph, merging of edges, footholds and vocabulary checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwarden.functions.scalars import text
from arcwarden.operators.aws import aws_permission_edges
from arcwarden.operators.azure import azure_permission_edges
from arcwarden.operators.base_graph import build_base
from arcwarden.operators.derive import DeriveConfig, fixpoint
from arcwarden.operators.substrings import containing
from arcwarden.operators.gcp import foothold_node, gcp_permission_edges
from arcwarden.tables import is_empty, small, stored


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row of each ``edge_id``: arrays united in order of ``seq``, all else from the first row.

    Without a ``seq``, rows are ordered by content, which is stable where file order isn't.
    """
    lists = [c for c in ("permissions", "conditions", "facts", "derived_from") if c in edges.columns]
    rest = [c for c in edges.columns if c not in (*lists, "edge_id", "seq")]
    order = F.col("seq") if "seq" in edges.columns else F.xxhash64(*[F.col(c) for c in rest if dict(edges.dtypes)[c] != "variant"])
    rows = edges.withColumn("_o", order).groupBy("edge_id").agg(F.min_by(F.struct(*rest), F.struct("_o", *[F.col(c).cast("string") for c in rest if not dict(edges.dtypes)[c].startswith(("map", "variant"))])).alias("f"), *[F.sort_array(F.collect_list(F.struct("_o", F.coalesce(c, F.array().cast("array<string>")).alias("v")))).alias(c) for c in lists])
    united = [F.array_distinct(F.flatten(F.transform(c, lambda x: x["v"]))).alias(c) for c in lists]
    return rows.select("edge_id", "f.*", *united).select(*[c for c in edges.columns if c != "seq"])


def vocab_conformance(edges: DataFrame, nodes: DataFrame, edge_types: DataFrame, node_types: DataFrame) -> DataFrame:
    """``(part, name, n)`` of edge and node types that the vocabularies don't have."""
    bad_edges = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).join(small(edge_types.select("name").distinct()), "name", "left_anti")
    bad_nodes = nodes.groupBy(text("node_type").alias("name")).agg(F.count("*").alias("n")).join(small(node_types.select("name").distinct()), "name", "left_anti")
    return bad_edges.select(F.lit("edge_type").alias("part"), "name", "n").unionByName(bad_nodes.select(F.lit("node_type").alias("part"), "name", "n"))


def partition_by_provider(facts: DataFrame, provider: str) -> DataFrame:
    """Facts of one provider; an empty one counts as aws."""
    return facts.where(F.coalesce(F.nullif("provider", F.lit("")), F.lit("aws")) == provider)


def mark_footholds(nodes: DataFrame, callers: DataFrame) -> DataFrame:
    """Nodes with ``foothold``: for each of ``callers(caller)`` the node of that native name or arn, else of an arn that holds it.

    The smallest id where several fit. Callers that look like GCP accounts and fit nowhere get a node of their own.
    """
    named = callers.select(F.trim("caller").alias("caller")).where("caller != ''").distinct()
    native = nodes.select(F.substring_index("node_id", "|", -1).alias("caller"), "node_id").union(nodes.where(text("arn") != "").select("arn", "node_id"))
    exact = named.join(native, "caller").groupBy("caller").agg(F.min("node_id").alias("node_id"))
    rest = named.join(exact, "caller", "left_anti")
    rest, arns = stored(rest, "callers"), nodes.where(text("arn") != "").select("arn", "node_id")
    held = containing(arns.select(F.col("arn").alias("text")), rest.select(F.col("caller").alias("pattern")))
    part = arns.join(held.select(F.col("text").alias("arn"), F.col("pattern").alias("caller")), "arn").groupBy("caller").agg(F.min("node_id").alias("node_id"))
    found = exact.unionByName(part)
    made = foothold_node(F.col("caller"))
    new = rest.join(part, "caller", "left_anti").where(F.col("caller").endswith("gserviceaccount.com")).select(made.alias("n"), "caller").select("n.node_id", "n.node_type", F.lit("gcp").alias("provider"), F.split_part("n.node_id", F.lit("|"), F.lit(2)).alias("account"), F.col("caller").alias("arn"), F.lit(True).alias("foothold"))
    feet = stored(found.select("node_id").distinct(), "footholds").withColumn("foothold", F.lit(True))
    marked = nodes.join(small(feet), "node_id", "left").withColumn("foothold", F.coalesce("foothold", F.lit(False)))
    return marked.unionByName(new.dropDuplicates(["node_id"]), allowMissingColumns=True)


def assemble_graph(inventory: DataFrame, facts: DataFrame, callers: DataFrame | None = None, derive: DeriveConfig = DeriveConfig()) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)``: base graph, permissions of each provider, footholds, and everything derived from them."""
    nodes, base = build_base(inventory, facts)
    nodes, base = stored(nodes, "nodes"), stored(base, "base")
    edges, columns = base, ["edge_id", "type", "source", "target", "scope", "relationship_kind", "nature", "provider", "state", "confidence", "weight", "permissions", "conditions", "facts", "evidence"]
    edges = edges.select(*columns).unionByName(aws_permission_edges(partition_by_provider(facts, "aws"), nodes).select(*columns))
    for provider, evaluate in (("gcp", gcp_permission_edges), ("azure", azure_permission_edges)):
        own = partition_by_provider(facts, provider)
        if not is_empty(own):
            more, extra = evaluate(own, nodes.where(F.col("provider") == provider))
            edges = edges.unionByName(more.select(*columns))
            nodes = stored(nodes.unionByName(extra.join(nodes.select("node_id"), "node_id", "left_anti").dropDuplicates(["node_id"]), allowMissingColumns=True), "nodes")
    if callers is not None:
        nodes = stored(mark_footholds(nodes, callers), "nodes")
    merged = stored(merge_edges(edges), "explicit")
    derived = fixpoint(merged, nodes, derive)
    return nodes, merged.unionByName(derived, allowMissingColumns=True)
