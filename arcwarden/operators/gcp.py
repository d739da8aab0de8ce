"""Effective permissions in the binding model: members hold roles on a project or on one resource."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.catalog import GCP_CAPABILITIES
from arcwarden.functions.scalars import blank, fact_id, identity_realm, is_provider_managed, json_text, last_seg, native_of, split_member, text
from arcwarden.operators.grants import GRANTED, class_edges, class_grants, classes, dedup_upgrade, written_in_blocks
from arcwarden.tables import config_frame, is_empty, small, stored


def capabilities(spark) -> DataFrame:
    rows = [(k, edge, perm, list(types), kind, weight) for k, (edge, perm, types, kind, weight) in enumerate(GCP_CAPABILITIES)]
    return config_frame(spark, rows, "ord int, edge string, permission string, types array<string>, kind string, weight double")


def binding_grants(facts: DataFrame) -> DataFrame:
    """``(member, project, target, permissions, conditional, facts)``: one row of a member and project, or member and resource.

    Conditional only if every binding behind the row has a condition. Bindings of unknown or empty roles are dropped.
    """
    lists = facts.where("kind = 'role_permissions'").select(F.col("source").alias("role"), F.explode(F.from_json(json_text("attributes", "permissions"), "array<string>")).alias("permission")).distinct()
    bound = facts.where("kind = 'iam_binding'").select(
        F.col("source").alias("member"), json_text("attributes", "role").alias("role"), (json_text("attributes", "level") == "project").alias("wide"), text("scope.account").alias("project"), "target",
        (~blank(json_text("attributes", "condition"))).alias("conditioned"), fact_id("provider", "kind", "source", "target", "edge_hint", "scope.account").alias("fact_id"),
    ).withColumn("wide", F.coalesce("wide", F.lit(False)))
    keyed = bound.withColumn("project", F.when(F.col("wide"), F.col("project"))).withColumn("target", F.when(~F.col("wide"), F.col("target")))
    known = keyed.join(lists.select("role").distinct(), "role", "left_semi")
    state = known.groupBy("member", "project", "target").agg(F.min("conditioned").alias("conditional"), F.array_sort(F.collect_set("fact_id")).alias("facts"))
    held = known.join(lists, "role").groupBy("member", "project", "target").agg(F.collect_set("permission").alias("permissions"))
    same = F.col("s.member").eqNullSafe(F.col("h.member")) & F.col("s.project").eqNullSafe(F.col("h.project")) & F.col("s.target").eqNullSafe(F.col("h.target"))
    return state.alias("s").join(held.alias("h"), same).select("s.*", "h.permissions")


def conditional_flag(conditioned: Column) -> Column:
    """Aggregate: conditional if every contributing binding is."""
    return F.min(conditioned)


def exclude_provider_agents(grants: DataFrame) -> DataFrame:
    return grants.where(~is_provider_managed("member"))


def resource_name_index(nodes: DataFrame) -> DataFrame:
    """``(name, node_id)`` by arn, native name and their last segments; the largest id wins where names are shared."""
    names = F.array("arn", last_seg("arn"), native_of("node_id"), last_seg(native_of("node_id")))
    return nodes.select("node_id", F.explode(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))).alias("name")).groupBy("name").agg(F.max("node_id").alias("node_id"))


def resolve_members(grants: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(member, source)`` and the synthetic nodes; deleted members and unknown kinds have no node."""
    split = grants.select("member").distinct().withColumn("m", split_member("member")).where("m is not null")
    kind, value = F.col("m.kind"), F.col("m.value")
    types = {"serviceAccount": ("ServiceAccount", "gcp:iam:service-account"), "user": ("HumanIdentity", "gcp:iam:user"), "group": ("Group", "gcp:iam:group"), "domain": ("Group", "gcp:iam:domain"), "principal": ("FederatedIdentity", "gcp:iam:principal"), "principalSet": ("FederatedIdentity", "gcp:iam:principal-set"), "allUsers": ("Everyone", "gcp:iam:public"), "allAuthenticatedUsers": ("Everyone", "gcp:iam:public")}
    of = lambda k: F.coalesce(*[F.when(kind == name, F.lit(t[k])) for name, t in types.items()])
    named = split.withColumn("node_type", of(0)).withColumn("resource", of(1)).where("node_type is not null")
    native = F.when(value == "", kind).otherwise(value)
    made = named.withColumn("realm", identity_realm(kind, value)).withColumn("made", F.concat_ws("|", F.lit("gcp"), "realm", "resource", native))
    inventory = nodes.where("node_type = 'ServiceAccount'").select(F.explode(F.array_distinct(F.filter(F.array("arn", native_of("node_id"), json_text("attributes", "email")), lambda x: x.isNotNull() & (x != "")))).alias("mail"), F.col("node_id").alias("known"))
    inventory = inventory.groupBy("mail").agg(F.min("known").alias("known"))
    met = made.join(inventory, (kind == "serviceAccount") & (value == F.col("mail")), "left")
    resolved = met.select("member", F.coalesce("known", "made").alias("source"))
    new = met.where("known is null").select(F.col("made").alias("node_id"), "node_type", F.lit("gcp").alias("provider"), F.col("realm").alias("account"), native.alias("arn"), F.to_json(F.struct(F.lit(True).alias("synthesized"))).alias("attributes"))
    return resolved, new.dropDuplicates(["node_id"])


def _held(grants: DataFrame, cfg: DataFrame) -> DataFrame:
    """Grants once for each capability whose permission they hold."""
    return grants.withColumn("permission", F.explode("permissions")).drop("permissions").join(F.broadcast(cfg), "permission")


def project_wide_edges(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """Project grants on every resource of the capability's types in the grant's own project; ``held`` and ``nodes`` are stored or cheap to read."""
    typed = held.where("target is null").withColumn("node_type", F.explode("types")).drop("target")
    targets = nodes.select(F.col("account").alias("project"), "node_type", F.col("node_id").alias("target"), text("arn").alias("scope"))
    return written_in_blocks(typed, targets.where("project is not null and node_type is not null"), ["project", "node_type"], ["source", "edge"]).select(*GRANTED)


def resource_scoped_edges(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """Resource grants on the resource they name, by its name or the name's last segment, if its type fits."""
    index = resource_name_index(nodes)
    rows = held.where("target is not null").withColumnRenamed("target", "name").withColumn("short", last_seg("name"))
    met = rows.join(index.select(F.col("name"), F.col("node_id").alias("by_name")), "name", "left").join(index.select(F.col("name").alias("short"), F.col("node_id").alias("by_short")), "short", "left")
    found = met.withColumn("target", F.coalesce("by_name", "by_short")).where("target is not null")
    typed = found.join(nodes.select(F.col("node_id").alias("target"), "node_type", text("arn").alias("scope")), "target").where(F.array_contains("types", F.coalesce("node_type", F.lit(""))))
    return typed.withColumn("ord", F.col("ord") + 1000).select(*GRANTED)


def _by_class(held: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Project grants by classes of resources of one project and type: the best of each, and the classes' members."""
    key = lambda project: F.concat_ws("\n", "node_type", project)
    members, keys = classes(nodes.where("account is not null and node_type is not null").select(F.col("node_id").alias("target"), text("arn").alias("scope"), key(F.col("account")).alias("key")))
    typed = held.where("target is null").withColumn("node_type", F.explode("types")).drop("target").withColumn("key", F.when(F.col("project").isNotNull(), key(F.col("project"))))
    return class_grants(typed.join(small(keys), "key")), members


def gcp_permission_edges(facts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Permission edges and the identities that only bindings know.

    Project grants are settled by class and written out last; only edges that a resource's own grants give too are met with these.
    """
    grants = stored(exclude_provider_agents(binding_grants(facts)), "grants")
    members, new = resolve_members(grants, nodes)
    held = stored(_held(grants.join(members, "member"), capabilities(nodes.sparkSession)), "held")
    best, spots = _by_class(held, nodes)
    own = stored(resource_scoped_edges(held, nodes), "own")
    edge = ["edge", "source", "target", "scope"]
    both = stored(own.select(*edge).distinct(), "both")
    if is_empty(both):
        return class_edges(best, spots, "gcp", "iam-binding"), new
    # a project's grant has the smaller ord, so it gives the fields; an edge is conditional only if both grants are
    given = stored(both.join(spots, ["target", "scope"]).join(best, ["edge", "source", "class"]).select("class", *edge, "f.kind", "f.weight", "f.permission", F.lit(-1).alias("ord"), "conditional", "f.facts"), "given")
    rest = class_edges(best, spots, "gcp", "iam-binding", given.select("class", *edge))
    return dedup_upgrade(own.select(*GRANTED).unionByName(given.select(*GRANTED)), "gcp", "iam-binding").unionByName(rest), new


def foothold_node(caller: Column) -> Column:
    """``struct<node_id, node_type>`` of a caller's address; null without an at sign."""
    domain = F.substring_index(caller, "@", -1)
    service = caller.endswith("gserviceaccount.com")
    realm = F.when(domain.endswith(".iam.gserviceaccount.com"), F.regexp_replace(domain, r"\.iam\.gserviceaccount\.com$", "")).when(service, F.lit("external")).otherwise(domain)
    kind = F.when(service, F.lit("gcp:iam:service-account")).otherwise(F.lit("gcp:iam:user"))
    node = F.struct(F.concat_ws("|", F.lit("gcp"), realm, kind, caller).alias("node_id"), F.when(service, F.lit("ServiceAccount")).otherwise(F.lit("HumanIdentity")).alias("node_type"))
    return F.when(F.contains(caller, F.lit("@")), node)
