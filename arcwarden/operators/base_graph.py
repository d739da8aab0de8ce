"""Nodes from inventory and direct edges from facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwarden.catalog import ACCOUNT_KEYS, EVALUATOR_KINDS
from arcwarden.functions.scalars import account_of, blank, edge_id, endpoint_type, fact_id, json_text, node_id, text
from arcwarden.operators.policy import allows, condition_labels, parse_policy_statements

REFS = ["type", "source_ref", "source_fallback", "target_ref", "target_fallback", "provider", "relationship_kind", "state", "confidence", "weight", "scope", "permissions", "conditions", "facts", "evidence"]


def _order(df: DataFrame) -> list[Column]:
    """File order where it is given as ``seq``, else content."""
    return [F.col("seq")] if "seq" in df.columns else [F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))])]


def nodes_from_inventory(inventory: DataFrame) -> DataFrame:
    """One node for each artifact id; the first row wins."""
    named = inventory.withColumn("node_id", node_id("provider", "account", "resource_type", "native_id"))
    first = Window.partitionBy("node_id").orderBy(*_order(inventory))
    rows = named.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.select("node_id", "node_type", "provider", "account", "arn", "scope", "attributes")


def arn_index(inventory: DataFrame) -> DataFrame:
    """``(arn, node_id)``; the last row of an arn wins."""
    named = inventory.where(~blank("arn")).withColumn("node_id", node_id("provider", "account", "resource_type", "native_id"))
    return named.groupBy("arn").agg(F.max_by("node_id", F.struct(*_order(inventory), "node_id")).alias("node_id"))


def _edge_refs(df: DataFrame, **columns: Column) -> DataFrame:
    empty = F.array().cast("array<string>")
    defaults = {"source_fallback": F.lit(None).cast("string"), "target_fallback": F.lit(None).cast("string"), "state": F.lit("ACTIVE"), "confidence": F.lit(1.0), "weight": F.lit(1.0), "scope": F.lit(""), "permissions": empty, "conditions": empty, "facts": empty, "evidence": F.lit(None).cast("string")}
    return df.select(*[(columns.get(c, defaults.get(c, F.col(c)))).alias(c) for c in REFS])


def edges_from_trust(facts: DataFrame) -> DataFrame:
    """Who may assume a role: named principals, and services at more weight and less confidence."""
    rows = parse_policy_statements(facts.where("kind = 'trust_policy'"), ("document",)).where(allows())
    named = _edge_refs(rows.withColumn("p", F.explode("principals")).where("p != '*'"), type=F.lit("CanAssume"), source_ref=F.col("p"), source_fallback=F.lit("Identity"), target_ref=F.col("source"), target_fallback=F.lit("Role"), relationship_kind=F.lit("AUTHORIZATION"))
    served = _edge_refs(rows.withColumn("p", F.explode("services")), type=F.lit("CanAssume"), source_ref=F.concat(F.lit("service:"), F.col("p")), source_fallback=F.lit("Service"), target_ref=F.col("source"), target_fallback=F.lit("Role"), relationship_kind=F.lit("AUTHORIZATION"), confidence=F.lit(0.9), weight=F.lit(2.0))
    return named.unionByName(served)


def same_account_confined(conditions: Column, account: Column) -> Column:
    """Whether some equality on a caller-account key holds the resource's own account."""
    own = lambda c: F.contains(F.lower(c["op"]), F.lit("stringequals")) & F.lower(c["key"]).isin(*ACCOUNT_KEYS) & F.array_contains(c["values"], account)
    return (account != "") & F.exists(conditions, own)


def edges_from_resource_policy(facts: DataFrame) -> DataFrame:
    """Resources whose policy lets in everyone (unless confined to the own account) or another account's principals."""
    rows = parse_policy_statements(facts.where("kind = 'resource_policy'"), ("policy", "document")).where(allows()).withColumn("own", account_of("source"))
    fixed = {"type": F.lit("CrossAccountTrust"), "source_ref": F.col("source"), "source_fallback": F.lit("Resource"), "relationship_kind": F.lit("AUTHORIZATION"), "scope": F.col("source"), "permissions": F.col("actions"), "facts": F.array("fact_id")}
    open_ = rows.where(F.col("public") & ~same_account_confined(F.col("conditions"), F.col("own")))
    state = F.when(F.size("conditions") > 0, F.lit("CONDITIONAL")).otherwise(F.lit("ACTIVE"))
    everyone = _edge_refs(open_, **fixed, target_ref=F.lit("principal:*"), target_fallback=F.lit("Everyone"), state=state, conditions=condition_labels("conditions"), evidence=F.to_json(F.struct((F.size("conditions") == 0).alias("public"), "sid")))
    others = rows.where(~F.col("public")).withColumn("p", F.explode("principals")).withColumn("theirs", account_of("p")).where("theirs = '' or own = '' or theirs != own")
    return everyone.unionByName(_edge_refs(others, **fixed, target_ref=F.col("p"), target_fallback=F.lit("Identity"), evidence=F.to_json(F.struct(F.col("theirs").alias("external_account"), "sid"))))


POLICY_KINDS = ("trust_policy", "resource_policy")


def edges_direct(facts: DataFrame) -> DataFrame:
    """Edges that facts state themselves: source, target and hint."""
    kind = F.when(F.col("kind") == "network_rule", F.lit("NETWORK")).when(F.col("kind") == "membership", F.lit("STRUCTURAL")).otherwise(F.lit("AUTHORIZATION"))
    usable = facts.where(~F.col("kind").isin(*POLICY_KINDS, *EVALUATOR_KINDS) & ~blank("edge_hint") & ~blank("source") & ~blank("target"))
    port = json_text("attributes", "port")
    permissions = F.when(port.isNotNull(), F.array(F.concat(F.lit("port:"), port))).otherwise(F.array().cast("array<string>"))
    who = fact_id("provider", "kind", "source", "target", "edge_hint", "scope.account")
    return _edge_refs(usable, type=F.col("edge_hint"), source_ref=F.col("source"), target_ref=F.col("target"), relationship_kind=kind, scope=text("scope.region"), permissions=permissions, facts=F.array(who))


def edges_executes_as(inventory: DataFrame) -> DataFrame:
    """Artifacts with a role attribute execute as that role."""
    keys = ("role_arn", "Configuration.Role", "role", "execution_role")
    role = F.coalesce(*[F.when(json_text("attributes", k).startswith("arn:"), json_text("attributes", k)) for k in keys])
    rows = inventory.withColumn("role", role).where("role is not null").withColumn("id", node_id("provider", "account", "resource_type", "native_id"))
    return _edge_refs(rows, type=F.lit("ExecutesAs"), source_ref=F.col("id"), target_ref=F.col("role"), target_fallback=F.lit("Role"), relationship_kind=F.lit("EXECUTION"))


def resolve_endpoints(refs: DataFrame, nodes: DataFrame, arns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with node ids for their references, and the synthetic nodes that these need.

    An arn becomes the inventory's node or ``arn|<arn>``; a known node id stays; anything else is ``name|<name>``.
    """
    by_arn = arns.select(F.col("arn").alias("_arn"), F.col("node_id").alias("_known"))
    by_id = nodes.select(F.col("node_id").alias("_id")).distinct()

    def resolved(df: DataFrame, end: str) -> DataFrame:
        ref = F.col(f"{end}_ref")
        found = df.join(by_arn, ref == F.col("_arn"), "left").join(by_id, ref == F.col("_id"), "left")
        id_ = F.coalesce("_known", "_id", F.when(ref.startswith("arn:"), F.concat(F.lit("arn|"), ref)).otherwise(F.concat(F.lit("name|"), ref)))
        made = F.col("_known").isNull() & F.col("_id").isNull()
        return found.withColumn(end, id_).withColumn(f"{end}_new", made).drop("_arn", "_known", "_id")

    both = resolved(resolved(refs, "source"), "target")
    ends = [both.where(f"{end}_new").select(F.col(end).alias("node_id"), F.col(f"{end}_ref").alias("ref"), F.col(f"{end}_fallback").alias("fallback"), "provider") for end in ("source", "target")]
    arn = F.col("ref").startswith("arn:")
    type_ = F.coalesce("fallback", F.when(arn, F.lit("Resource")).otherwise(endpoint_type("ref")))
    synthetic = ends[0].unionByName(ends[1]).groupBy("node_id").agg(F.min(F.struct(type_.alias("t"), "ref", "provider")).alias("s"))
    fresh = synthetic.select(
        "node_id", F.col("s.t").alias("node_type"), F.col("s.provider").alias("provider"), F.when(F.col("s.ref").startswith("arn:"), account_of("s.ref")).otherwise(F.lit("")).alias("account"),
        F.when(F.col("s.ref").startswith("arn:"), F.col("s.ref")).alias("arn"), F.to_json(F.struct(F.lit(True).alias("synthetic"), F.when(~F.col("s.ref").startswith("arn:"), F.col("s.ref")).alias("name"))).alias("attributes"),
    )
    edges = both.drop("source_ref", "target_ref", "source_fallback", "target_fallback", "source_new", "target_new").withColumn("nature", F.lit("explicit"))
    return edges.withColumn("edge_id", edge_id("type", "source", "target", "scope")), fresh


def build_base(inventory: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (synthetic ones included) and explicit edges."""
    nodes = nodes_from_inventory(inventory)
    refs = reduce(DataFrame.unionByName, [edges_from_trust(facts), edges_from_resource_policy(facts), edges_direct(facts), edges_executes_as(inventory)])
    edges, synthetic = resolve_endpoints(refs, nodes, arn_index(inventory))
    return nodes.unionByName(synthetic, allowMissingColumns=True), edges


def build_stats(facts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(part, n)``: edges by nature, synthetic nodes, and facts that make no direct edge."""
    by_nature = edges.groupBy(F.concat(F.col("nature"), F.lit("_edges")).alias("part")).agg(F.count("*").alias("n"))
    synthetic = nodes.where("node_id like 'arn|%' or node_id like 'name|%'").agg(F.count("*").alias("n")).select(F.lit("synthetic_nodes").alias("part"), "n")
    usable = ~blank("edge_hint") & ~blank("source") & ~blank("target")
    skipped = facts.where(F.col("kind").isin(*EVALUATOR_KINDS) | ~F.col("kind").isin(*POLICY_KINDS) & ~usable).agg(F.count("*").alias("n")).select(F.lit("skipped_facts").alias("part"), "n")
    return by_nature.unionByName(synthetic).unionByName(skipped)
