"""The query layer over nodes and edges: explorations, lists, details, exposures, findings and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.catalog import HIGH_VALUE_TYPES, IDENTITY_TYPES
from arcwarden.functions.scalars import b64_text, cluster_of, is_admin, json_text, kind_of, label, node_account, node_class, norm_identity, preview, text
from arcwarden.operators.condense import condensed, strong_components
from arcwarden.operators.traverse import bfs_depth, bfs_pairs, bfs_within, least_costs, nearest_target, path_edges, relax
from arcwarden.tables import is_empty, small, stored

EVERYONE = (*IDENTITY_TYPES, "Everyone")
MAX_OBJECTIVES, MAX_PRINCIPALS, MAX_NODES, MAX_EDGES = 40, 400, 500, 1000


def graph_node_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes, and an ``External`` row for each endpoint without one."""
    ends = edges.select(F.col("source").alias("node_id")).union(edges.select("target")).where("node_id is not null").distinct()
    outside = ends.join(nodes.select("node_id"), "node_id", "left_anti").withColumn("node_type", F.lit("External"))
    return nodes.unionByName(outside, allowMissingColumns=True)


def _induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    ids = stored(keep.select("node").distinct(), "keep")
    inside = edges.join(small(ids.withColumnRenamed("node", "source")), "source", "left_semi")
    return inside.join(small(ids.withColumnRenamed("node", "target")), "target", "left_semi").select(*edges.columns)


def explore_all(edges: DataFrame) -> DataFrame:
    """Every node on an edge."""
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()


def explore_reachable(edges: DataFrame, start: DataFrame, max_hops: int = 12) -> DataFrame:
    """Edges from one layer of the forward search to the next, with ``layer`` (of the target)."""
    depth = stored(bfs_depth(edges, start, max_hops), "depth")
    a = depth.select(F.col("node").alias("source"), F.col("depth").alias("from_layer"))
    b = depth.select(F.col("node").alias("target"), F.col("depth").alias("layer"))
    return edges.join(small(a), "source").join(small(b), "target").where("layer = from_layer + 1").select(*edges.columns, "layer")


def explore_reaches(edges: DataFrame, targets: DataFrame, max_hops: int = 12) -> DataFrame:
    """Edges between nodes that reach a target."""
    return _induced(edges, bfs_within(edges, targets, max_hops, "backward"))


def explore_path(edges: DataFrame, start: DataFrame, targets: DataFrame, max_hops: int = 12) -> DataFrame:
    """Edges from the forward set of the start into the backward set of the targets; ``on_path`` marks the cheapest path."""
    ahead = stored(bfs_within(edges, start, max_hops), "ahead")
    behind = stored(bfs_within(edges, targets, max_hops, "backward"), "behind")
    between = edges.join(small(ahead.withColumnRenamed("node", "source")), "source", "left_semi").join(small(behind.withColumnRenamed("node", "target")), "target", "left_semi")
    tree = relax(between, start, max_hops)
    ends = least_costs(tree).join(targets.select("node"), "node", "left_semi").where("node != start")
    nearest = stored(ends.groupBy("start").agg(F.min(F.struct("cost", "node", "hops")).alias("b")).select("start", "b.node", "b.hops"), "ends")
    chosen = path_edges(tree, nearest).select("edge_id", F.lit(True).alias("on_path")).distinct()
    return between.join(chosen, "edge_id", "left").withColumn("on_path", F.coalesce("on_path", F.lit(False))).select(*edges.columns, "on_path")


def resolve_targets(nodes: DataFrame, to: str) -> DataFrame:
    """A node id, or all nodes of ``type:<T>``."""
    picked = nodes.where(F.col("node_type") == to.removeprefix("type:")) if to.startswith("type:") else nodes.where(F.col("node_id") == to)
    return picked.select(F.col("node_id").alias("node"))


def admin_identities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Identities that are admins by name, by an administrator policy, or by a group of admins."""
    people = nodes.where(F.col("node_type").isin(*EVERYONE))
    target = F.lower(text("target"))
    granted = edges.where((F.col("type") == "HasPolicy") & F.contains(target, F.lit("administratoraccess")) | (F.col("type") == "MemberOf") & F.contains(target, F.lit("admin")))
    by_edge = people.join(granted.select(F.col("source").alias("node_id")), "node_id", "left_semi")
    return people.where(is_admin("node_id", "arn")).select(F.col("node_id").alias("node")).union(by_edge.select("node_id")).distinct()


def preset_targets(nodes: DataFrame, edges: DataFrame, preset: str) -> DataFrame:
    """Targets of ``admin``, or of ``high_value``: admins and nodes of the most valuable types."""
    admins = admin_identities(nodes, edges)
    if preset == "admin":
        return admins
    return admins.union(nodes.where(F.col("node_type").isin(*HIGH_VALUE_TYPES)).select("node_id")).distinct()


def explore_preset(nodes: DataFrame, edges: DataFrame, preset: str, start: DataFrame | None = None, account: str = "", max_hops: int = 12) -> DataFrame:
    """``(start, node, cost, hops)`` of paths to the preset's targets.

    From a start: to each target within reach (the first 40 by id). Without: from the first 400 identities (of the account) that
    aren't targets, each to its nearest target.
    """
    targets = stored(preset_targets(nodes, edges, preset), "targets")
    if start is not None:
        found = least_costs(relax(edges, start, max_hops)).join(small(targets), "node", "left_semi").where("node != start")
        return found.orderBy("node").limit(MAX_OBJECTIVES)
    people = nodes.where(F.col("node_type").isin(*EVERYONE) & ((F.lit(account) == "") | (F.col("account") == account)))
    first = people.select(F.col("node_id").alias("node")).orderBy("node").limit(MAX_PRINCIPALS).join(small(targets), "node", "left_anti")
    return nearest_target(edges, targets, max_hops).join(small(first, MAX_PRINCIPALS), "node").select(F.col("node").alias("start"), F.col("target").alias("node"), "cost", "hops")


def node_list(nodes: DataFrame) -> DataFrame:
    """``(position, id, label, node_type, kind)``: identities first, then by type and label; without regions and external nodes."""
    shown = nodes.select(F.col("node_id").alias("id"), label("node_id", "attributes").alias("label"), F.coalesce(F.nullif("node_type", F.lit("")), F.lit("Unknown")).alias("node_type"), kind_of("node_id", "node_type").alias("kind"))
    shown = shown.where(~F.contains("kind", F.lit("account:region")) & (F.col("node_type") != "External"))
    return shown.orderBy(F.when(F.col("node_type").isin(*EVERYONE), 0).otherwise(1), "node_type", F.lower("label"), "id")


def node_search(nodes: DataFrame, term: str, top: int = 30) -> DataFrame:
    """Nodes whose label, kind or id holds the term: those whose label starts with it first, then those whose label holds it."""
    t = F.lit(term.lower())
    listed = node_list(nodes)
    low = F.lower("label")
    rank = F.when(F.startswith(low, t), 0).when(F.contains(low, t), 1).otherwise(2)
    hits = listed.where(F.contains(F.lower(F.concat_ws(" ", "label", "kind", "id")), t))
    return hits.withColumn("rank", rank).orderBy("rank", low, "id").limit(top)


def node_detail(nodes: DataFrame, edges: DataFrame, node: DataFrame) -> DataFrame:
    """``(node, part, type, other_id, other_label, other_type, state, nature)`` for outbound, inbound and grant edges of ``node(node)``."""
    attack = F.coalesce(F.col("relationship_kind") != "STRUCTURAL", F.lit(True))
    own = small(node.select("node").distinct())
    out = edges.join(own, F.col("source") == F.col("node")).withColumn("part", F.when(attack, "outbound").otherwise("grants")).withColumn("other_id", F.col("target"))
    into = edges.where(attack & (F.col("source") != F.col("target"))).join(own, F.col("target") == F.col("node")).withColumn("part", F.lit("inbound")).withColumn("other_id", F.col("source"))
    labels = nodes.select(F.col("node_id").alias("other_id"), label("node_id", "attributes").alias("l"), F.col("node_type").alias("other_type"))
    both = out.unionByName(into).join(labels, "other_id", "left")
    return both.select("node", "part", "type", "other_id", F.coalesce("l", label("other_id", F.lit(None).cast("string"))).alias("other_label"), text("other_type").alias("other_type"), "state", "nature").orderBy("node", "part", "type", "other_label")


def density_guard(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and whether they are too many to draw."""
    counts = edges.agg(F.count("*").alias("edges")).join(explore_all(edges).agg(F.count("*").alias("nodes")))
    return counts.select("nodes", "edges", ((F.col("nodes") > MAX_NODES) | (F.col("edges") > MAX_EDGES)).alias("too_dense"))


# Exposures and findings

SEVERITIES = ("critical", "high", "medium", "low")


def severity_rank(severity: Column) -> Column:
    s = F.lower(text(severity))
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), s), F.lit(0)) - 1, F.lit(len(SEVERITIES))).cast("int")


def finding_key(kind: Column, value_ref: Column, node: Column, name: Column, detail: Column) -> Column:
    who = F.coalesce(F.nullif(text(value_ref), F.lit("")), F.nullif(text(node), F.lit("")), text(name))
    return F.concat_ws(":", text(kind), who, text(detail))


def node_refs(nodes: DataFrame) -> DataFrame:
    """``(ref, node)``: ids, arns and native names to node ids; the smallest id where a name is shared."""
    refs = nodes.select("node_id", F.explode(F.array_distinct(F.array_compact(F.array("node_id", F.nullif("arn", F.lit("")), F.substring_index("node_id", "|", -1))))).alias("ref"))
    exact = F.when(F.col("ref") == F.col("node_id"), 0).otherwise(1)
    return refs.groupBy("ref").agg(F.min_by("node_id", F.struct(exact, "node_id")).alias("node"))


def exposures(nodes: DataFrame, edges: DataFrame, findings: DataFrame | None = None, foothold: DataFrame | None = None) -> DataFrame:
    """Credentials found, public, internet and cross-account exposures, each once, with what the foothold reaches in 20 hops."""
    typed = edges.join(nodes.select(F.col("node_id").alias("source"), F.col("node_type").alias("source_type")), "source", "left")
    public = (F.col("source_type") == "Everyone") & (F.col("state") == "ACTIVE")
    everyone = F.contains(text("target"), F.lit("principal:*"))
    kind = (
        F.when(F.coalesce(public, F.lit(False)), F.lit("public")).when(F.col("type") == "ExposedToInternet", F.lit("internet"))
        .when((F.col("type") == "CrossAccountTrust") & everyone & (F.col("state") == "ACTIVE"), F.lit("public_policy")).when((F.col("type") == "CrossAccountTrust") & ~everyone, F.lit("cross_account"))
    )
    worst = F.col("type").isin("CanInvoke", "CanReadData", "CanReadSecret", "CanControl")
    evidence = F.col("evidence") if "evidence" in edges.columns else F.lit(None).cast("string")
    marked = typed.withColumn("k", kind).where("k is not null")
    by_edge = marked.select(
        F.when(F.col("k") == "public_policy", F.lit("public")).otherwise(F.col("k")).alias("kind"),
        F.when(F.col("k") == "public", F.col("target")).otherwise(F.col("source")).alias("node"),
        F.when(F.col("k") == "public", F.when(worst, "critical").otherwise("high")).when(F.col("k") == "internet", F.coalesce(json_text(evidence, "severity"), F.lit("high"))).when(F.col("k") == "public_policy", "critical").otherwise("medium").alias("severity"),
        F.when(F.col("k") == "public", F.concat(F.lit("open to everyone: "), F.col("type"))).when(F.col("k") == "internet", F.coalesce(json_text(evidence, "exposure"), F.lit("open to the internet"))).when(F.col("k") == "public_policy", "policy names everyone").otherwise("policy names another account").alias("detail"),
        F.lit("").alias("value_ref"), F.lit("").alias("preview"),
    )
    items = by_edge
    if findings is not None:
        refs = node_refs(nodes)
        found = findings.where("coalesce(found, true)").join(refs, findings["resource_id"] == refs["ref"], "left")
        detail = F.coalesce(F.nullif("location", F.lit("")), F.nullif("emits_hint", F.lit("")), F.lit("credential"))
        items = items.unionByName(found.select(F.lit("credential").alias("kind"), text("node").alias("node"), F.lower(F.coalesce("severity", F.lit("high"))).alias("severity"), detail.alias("detail"), text("value_ref").alias("value_ref"), preview("value_ref", 110).alias("preview")))
    named = items.join(nodes.select(F.col("node_id").alias("node"), label("node_id", "attributes").alias("l"), "node_type"), "node", "left")
    name = F.coalesce("l", F.nullif(F.substring_index("node", "|", -1), F.lit("")), F.substring_index("detail", ".", 1))
    once = named.withColumn("label", name).dropDuplicates(["kind", "node", "detail", "value_ref", "label"])
    if foothold is None:
        reach = once.withColumn("reachable", F.lit(False))
    else:
        near = stored(bfs_within(edges, foothold, 20).select("node").distinct().withColumn("reachable", F.lit(True)), "near")
        reach = once.join(small(near), "node", "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))
    return exposure_filter_sort(reach.select("kind", "node", "label", text("node_type").alias("node_type"), "severity", "detail", "value_ref", "preview", "reachable"))


def exposure_filter_sort(items: DataFrame, severity: str | None = None, kind: str | None = None, reachable: bool | None = None, by: str = "severity") -> DataFrame:
    """Exposures of a severity, kind or reachability, sorted by severity, kind or label."""
    kept = items
    for column, wanted in (("severity", severity), ("kind", kind), ("reachable", reachable)):
        kept = kept if wanted is None else kept.where(F.col(column) == F.lit(wanted))
    first = {"severity": severity_rank(F.col("severity")), "kind": F.col("kind"), "label": F.lower("label")}[by]
    return kept.orderBy(first, F.desc("reachable"), "label", "kind", "detail")


def triage_join(items: DataFrame, status: DataFrame) -> DataFrame:
    """Exposures with the analyst's ``status(key, status, note)``; ``open`` where there is none."""
    keyed = items.withColumn("key", finding_key(F.col("kind"), F.col("value_ref"), F.col("node"), F.col("label"), F.col("detail")))
    return keyed.join(status.select("key", "status", "note"), "key", "left").withColumn("status", F.coalesce("status", F.lit("open")))


def decoded_findings(findings: DataFrame, value: str = "value", n: int = 110) -> DataFrame:
    """Findings with a preview of their decoded value, which itself isn't returned."""
    return findings.withColumn("preview", preview(b64_text(value, "location"), n)).drop(value)


# Rankings and reports


def objectives(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*HIGH_VALUE_TYPES) | is_admin("node_id", "arn")).select(F.col("node_id").alias("node")).distinct()


def report_paths(nodes: DataFrame, edges: DataFrame, foothold: DataFrame, max_hops: int = 12, top: int = MAX_OBJECTIVES) -> DataFrame:
    """``(start, node, cost, hops, state)``: the cheapest path to each of the first ``top`` objectives within reach, by id."""
    tree = relax(edges, foothold, max_hops)
    ends = least_costs(tree).join(small(stored(objectives(nodes), "goals")), "node", "left_semi").where("node != start").orderBy("node").limit(top)
    ends = stored(ends, "ends")
    states = path_edges(tree, ends).join(edges.select("edge_id", "state"), "edge_id").groupBy("start", F.col("end").alias("node")).agg(F.bool_or(F.col("state") == "CONDITIONAL").alias("c"))
    state = F.when(F.coalesce("c", F.lit(False)), "CONDITIONAL").otherwise("ACTIVE")
    return ends.join(states, ["start", "node"], "left").select("start", "node", "cost", "hops", state.alias("state")).orderBy("state", "hops", "node")


def reach_counts(edges: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    """``(node, reaches, goals)`` for each row of ``starts(node)``: nodes within reach, itself included, and those of ``goals(node)``.

    The members of a strongly connected component share one answer, and so do components with the same successors, but for what
    they hold themselves. So the closure is one of classes of components over components, and sizes are added up.
    """
    parts = strong_components(edges)
    between = condensed(edges, parts)
    ends = edges.select(F.col("source").alias("node")).union(edges.select("target")).union(starts.select("node")).where("node is not null").distinct()
    named = stored(ends.join(small(parts), "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    sizes = named.join(small(goals.select("node", F.lit(1).alias("goal"))), "node", "left").groupBy("component").agg(F.count("*").alias("size"), F.coalesce(F.sum("goal"), F.lit(0)).alias("goals"))
    sizes = stored(sizes, "sizes")
    wanted = stored(named.join(starts.select("node").distinct(), "node", "left_semi").select("node", "component"), "wanted")
    # what a component's successors are, as two hashes that don't depend on their order
    sums = [F.sum(F.xxhash64("target", F.lit(salt)).cast("decimal(38,0)")).alias(f"h{salt}") for salt in (1, 2)]
    first = between.join(wanted.select(F.col("component").alias("source")).distinct(), "source", "left_semi").groupBy("source").agg(F.count("*").alias("m"), *sums)
    first = stored(first, "successors")
    least = stored(first.groupBy("m", "h1", "h2").agg(F.min("source").alias("class")), "least")
    classes = stored(first.join(small(least), ["m", "h1", "h2"]).select(F.col("source").alias("component"), "class"), "classes")
    beyond = bfs_pairs(between, classes.select(F.col("class").alias("node")).distinct()).where("depth > 0")
    counted = beyond.join(small(sizes), F.col("node") == F.col("component")).groupBy(F.col("start").alias("class")).agg(F.sum("size").alias("more"), F.sum("goals").alias("more_goals"))
    own = wanted.join(small(sizes), "component").join(small(classes), "component", "left").join(small(stored(counted, "counted")), "class", "left")
    return own.select("node", (F.col("size") + F.coalesce("more", F.lit(0))).alias("reaches"), (F.col("goals") + F.coalesce("more_goals", F.lit(0))).alias("goals"))


def rank_footholds(nodes: DataFrame, edges: DataFrame, top: int = 25) -> DataFrame:
    """``(node_id, label, node_type, reaches, crown_jewels)``: identities by objectives and nodes within reach, themselves included."""
    people = nodes.where(F.col("node_type").isin(*EVERYONE))
    counted = reach_counts(edges, people.select(F.col("node_id").alias("node")), stored(objectives(nodes), "goals"))
    named = counted.join(people.select(F.col("node_id").alias("node"), label("node_id", "attributes").alias("label"), "node_type"), "node")
    return named.select(F.col("node").alias("node_id"), "label", "node_type", "reaches", F.col("goals").alias("crown_jewels")).orderBy(F.desc("crown_jewels"), F.desc("reaches"), "label", "node_id").limit(top)


def cross_scope_edges(edges: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """Edges between different known accounts (both in ``scopes(account)``)."""
    known = edges.withColumn("source_account", node_account("source")).withColumn("target_account", node_account("target")).where("source_account != '' and target_account != '' and source_account != target_account")
    for end in ("source_account", "target_account"):
        known = known if scopes is None else known.join(small(scopes.select(F.col("account").alias(end)).distinct()), end, "left_semi")
    return known


# Edge types that raise privileges by themselves, and node types that bound an organisation's parts.
ESCALATION_TYPES = ("CanEscalateTo", "CanGrantPermission", "CanImpersonate", "CanCreateCredentialFor", "CanSignAs", "CanTakeOwnership", "CanResetCredential", "CanAddMember", "CanPassIdentity")
BOUNDARY_TYPES = ("Tenant", "Subscription", "Project", "ManagementGroup", "Account", "Organization")


def escalation_flags(edges: DataFrame) -> DataFrame:
    """Edges with ``escalates``: by their type, or by a weight of 2 or more."""
    return edges.withColumn("escalates", F.col("type").isin(*ESCALATION_TYPES) | (F.coalesce("weight", F.lit(1.0)) >= 2))


def crown_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of a boundary type, and identities at the end of an escalating edge."""
    ends = escalation_flags(edges).where("escalates").select(F.col("target").alias("node_id"))
    people = nodes.where(F.col("node_type").isin(*EVERYONE)).join(ends, "node_id", "left_semi")
    return nodes.where(F.col("node_type").isin(*BOUNDARY_TYPES)).select("node_id").union(people.select("node_id")).distinct()


def collapse_parallel(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair of endpoints, the most telling one, and how many there are."""
    on_path = F.col("on_path").cast("int") if "on_path" in edges.columns else F.lit(0)
    cross = ((node_account("source") != node_account("target")) & (node_account("source") != "") & (node_account("target") != "")).cast("int")
    score = on_path * 1000 + cross * 500 + F.col("weight")
    ends = edges.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    return ends.groupBy("a", "b").agg(F.max_by("edge_id", F.struct(score, "edge_id")).alias("edge_id"), F.count("*").alias("parallel"))


def class_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(node_class("node_type").alias("class")).agg(F.count("*").alias("n"))


def cluster_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(cluster_of("node_id", "node_type").alias("cluster")).agg(F.count("*").alias("n"))


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(part, key, n)``: edges by type, edges by state, nodes by type, and the conditional edges, the largest first."""
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(untyped)"))
    one = F.lit(1).cast("long")
    counted = lambda name, key, n: F.struct(F.lit(name).alias("part"), key.alias("key"), n.cast("long").alias("n"))
    parts = F.array(counted("edge_type", named("type"), one), counted("edge_state", named("state"), one), counted("conditional", F.lit("total"), F.coalesce(F.col("state") == "CONDITIONAL", F.lit(False))))
    by = edges.select(F.inline(parts)).unionByName(nodes.select(F.inline(F.array(counted("node_type", named("node_type"), one)))))
    none = edges.sparkSession.range(1).select(F.lit("conditional").alias("part"), F.lit("total").alias("key"), F.lit(0).cast("long").alias("n"))
    return by.unionByName(none).groupBy("part", "key").agg(F.sum("n").alias("n")).orderBy("part", F.desc("n"), "key")


def custody_summary(manifest: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The manifest's fields with defaults, and the counts."""
    counts = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))
    fields = [text(c).alias(c) if c in manifest.columns else F.lit("").alias(c) for c in ("provider", "account", "caller_arn")]
    versions = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) if c in manifest.columns else F.lit("unknown").alias(c) for c in ("collector_version", "engine_version")]
    return manifest.limit(1).select(*fields, *versions).join(counts)


def resolve_foothold(nodes: DataFrame, caller: str, account: str = "") -> DataFrame:
    """The node that a caller's name stands for, by the first of these that finds one: id, identity attribute or native name,
    the role behind a session, part of an arn, normalised display name; the smallest id within it. At most one row."""
    inside = nodes.where((F.lit(account) == "") | (node_account("node_id") == account))
    c = F.lit(caller)
    attributes = [json_text("attributes", k) for k in ("userPrincipalName", "upn", "principalId", "objectId", "mail", "id")]
    exact = (F.substring_index("node_id", "|", -1) == c) | F.coalesce(F.array_contains(F.array_compact(F.array("arn", *attributes)), c), F.lit(False))
    tail = caller.rstrip("/").rsplit("/", 1)[-1]
    arn = text("arn")
    part = (arn != "") & (F.contains(arn, c) | (F.contains(arn, F.lit(tail)) if tail and tail != caller else F.lit(False)))
    role = caller.split(":assumed-role/")[1].split("/")[0] if ":assumed-role/" in caller else None
    session = (F.col("node_type") == "Role") & arn.endswith(f":role/{role}") if role else F.lit(False)
    name = norm_identity(F.coalesce(json_text("attributes", "displayName"), F.lit("")))
    tier = F.when(F.col("node_id") == c, 0).when(exact, 1).when(session, 2).when(part, 3).when((name != "") & (name == norm_identity(c)), 4)
    return inside.withColumn("tier", tier).where("tier is not null").groupBy().agg(F.min(F.struct("tier", "node_id")).alias("b")).where("b is not null").select(F.col("b.node_id").alias("node"), F.col("b.tier").alias("tier"))


def cheapest(edges: DataFrame) -> DataFrame:
    """One edge for each pair of endpoints: the least weight, then the smallest id."""
    return edges.groupBy("source", "target").agg(F.min_by("edge_id", F.struct("weight", "edge_id")).alias("edge_id"), F.min("weight").alias("weight"))


def has_path(edges: DataFrame, start: DataFrame, target: DataFrame, max_hops: int | None = None) -> bool:
    return not is_empty(bfs_within(edges, start, max_hops).join(target.select("node"), "node", "left_semi"))
