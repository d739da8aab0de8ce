"""Effective permissions in the scoped-role model, and the directory above it.

A scope covers an id if it is one of the id's ancestors; each id's ancestors are exploded, so cover is an equi-join. Role
definitions meet the capabilities once for each role, before any assignment. Assignments and denials meet classes of resources
that the same scopes cover; edges are written out last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.catalog import AZURE_CAPABILITIES
from arcwarden.functions.scalars import azure_wildcard_match, blank, edge_id, fact_id, json_text, last_seg, rg_scope_of, role_def_key, sub_of, text
from arcwarden.operators.grants import GRANTED, class_edges, class_grants, classes, dedup_upgrade
from arcwarden.tables import config_frame, is_empty, small, stored

GROUPS = "/providers/Microsoft.Management/managementGroups/"
TENANT = "azure|tenant|azure:entra:tenant|tenant"
ANONYMOUS = "azure|internet|azure:internet:anonymous|Anonymous"
# Node types of directory principals.
PRINCIPAL_TYPES = {"User": "HumanIdentity", "Group": "Group", "ServicePrincipal": "ServiceIdentity", "Application": "ApplicationIdentity", "ManagedIdentity": "ManagedIdentity"}
# Directory role templates (id, edge, what it reaches, relationship kind).
DIRECTORY_ROLES = (
    ("62e90394-69f5-4237-9190-012177145e10", "CanControl", "Tenant", "CONTROL"),
    ("e8611ab8-c189-46e8-94e1-60213ab1f814", "CanGrantPermission", "Tenant", "CONTROL"),
    ("9b895d92-2cd3-44c7-9d02-a6ac2d5ea5c3", "CanCreateCredentialFor", "ServiceIdentity", "CREDENTIAL"),
    ("158c047a-c907-4556-b7ef-446551a6b5f7", "CanCreateCredentialFor", "ServiceIdentity", "CREDENTIAL"),
    ("7be44c8a-adaf-4e2a-84d6-ab2649e08a13", "CanResetCredential", "HumanIdentity", "CREDENTIAL"),
    ("fe930be7-5e62-47db-91af-98c3a49a38b1", "CanResetCredential", "HumanIdentity", "CREDENTIAL"),
    ("c4e39bd9-1100-46d3-8c65-fb160da0071f", "CanResetCredential", "HumanIdentity", "CREDENTIAL"),
    ("fdd7a751-b60b-444a-984c-02652fe8fa1c", "CanAddMember", "Group", "CONTROL"),
)
# Application permissions of the directory's interface, likewise.
APP_ROLES = (
    ("9e3f62cf-ca93-4989-b6ce-bf83c28f9fe8", "CanGrantPermission", "Tenant", "CONTROL"),
    ("06b708a9-e830-4db3-a914-8e69da51d44f", "CanGrantPermission", "Tenant", "CONTROL"),
    ("19dbc75e-c2e2-444c-a770-ec69d8559fc7", "CanControl", "Tenant", "CONTROL"),
    ("1bfefb4e-e0b5-418b-a88f-73c46d2cc8e9", "CanCreateCredentialFor", "ServiceIdentity", "CREDENTIAL"),
    ("62a82d76-70ea-41e2-9197-370581804d09", "CanAddMember", "Group", "CONTROL"),
)


def _id(kind: str = "") -> Column:
    return fact_id("provider", "kind", "source", "target", "edge_hint", "scope.account")


def _list(key: str) -> Column:
    return F.coalesce(F.from_json(json_text("attributes", key), "array<string>"), F.array().cast("array<string>"))


def assignments(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'role_assignment'").select(F.col("source").alias("principal"), F.col("target").alias("scope"), role_def_key(json_text("attributes", "roleDefinitionId")).alias("role"), (~blank(json_text("attributes", "condition"))).alias("conditional"), _id().alias("fact_id"))


def expand_group_assignments(assigned: DataFrame, facts: DataFrame) -> DataFrame:
    """Assignments, and a copy of a group's for each of its members (membership is transitive already)."""
    members = facts.where("kind = 'member_of'").select(F.col("source").alias("member"), F.col("target").alias("principal")).distinct()
    inherited = assigned.join(members, "principal").withColumn("principal", F.col("member")).select(*assigned.columns)
    return assigned.unionByName(inherited)


def resolve_principals(ids: DataFrame, facts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(principal, source)`` for ``ids(principal)``, and synthetic nodes for those that no inventory node carries."""
    own = F.coalesce(F.get_json_object("attributes", "$.properties.principalId"), F.get_json_object("attributes", "$.identity.principalId"))
    inventory = nodes.withColumn("principal", own).where("principal is not null").groupBy("principal").agg(F.min("node_id").alias("known"))
    told = facts.where("kind = 'principal'").groupBy(F.col("source").alias("principal")).agg(F.min(F.struct(F.nullif(json_text("attributes", "displayName"), F.lit("")).alias("name"), F.nullif(json_text("attributes", "type"), F.lit("")).alias("type"))).alias("t"))
    met = ids.distinct().where(~blank("principal")).join(inventory, "principal", "left").join(told, "principal", "left")
    kind = F.coalesce("t.type", F.lit("ServicePrincipal"))
    types = F.create_map(*[x for k, v in PRINCIPAL_TYPES.items() for x in (F.lit(k), F.lit(v))])
    made = met.withColumn("made", F.concat(F.lit("azure|entra|azure:entra:"), F.lower(kind), F.lit("|"), F.col("principal"))).withColumn("node_type", F.coalesce(F.try_element_at(types, kind), F.lit("ServiceIdentity")))
    new = made.where("known is null").select(F.col("made").alias("node_id"), "node_type", F.lit("azure").alias("provider"), F.lit("entra").alias("account"), F.col("principal").alias("arn"), F.to_json(F.struct(F.lit(True).alias("synthesized"), F.coalesce("t.name", "principal").alias("displayName"))).alias("attributes"))
    return made.select("principal", F.coalesce("known", "made").alias("source")), new


def mg_closure(facts: DataFrame) -> DataFrame:
    """``(mg, subscription)``: every group with all subscriptions under it; cycles end at what is known."""
    edges = stored(facts.where("kind = 'mg_hierarchy'").select(F.col("source").alias("mg"), F.col("target").alias("child"), (json_text("attributes", "childType") == "subscription").alias("leaf")).distinct(), "mg")
    seen = stored(edges.select("mg", "child", "leaf"), "mg")
    fresh = seen
    while not is_empty(fresh):
        step = fresh.where("not leaf").select(F.col("mg").alias("top"), F.col("child").alias("mg")).join(edges, "mg").select(F.col("top").alias("mg"), "child", "leaf").distinct()
        fresh = stored(step.join(seen, ["mg", "child"], "left_anti"), "mg")
        seen = stored(seen.unionByName(fresh), "mg")
    return seen.where("leaf").select("mg", F.lower("child").alias("subscription")).distinct()


def container_nodes(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Subscriptions of accounts, management groups of the hierarchy, resource groups of resource ids; Azure nodes only."""
    own = nodes.where("provider = 'azure'")
    subs = own.where(~blank("account") & ~F.col("account").isin("tenant", "entra", "internet")).select("account").distinct()
    made = lambda df, id_, type_, account, arn, name: df.select(id_.alias("node_id"), F.lit(type_).alias("node_type"), F.lit("azure").alias("provider"), account.alias("account"), arn.alias("arn"), F.to_json(F.struct(F.lit(True).alias("synthesized"), name.alias("displayName"))).alias("attributes"))
    sub_arn = F.concat(F.lit("/subscriptions/"), F.col("account"))
    s = made(subs, F.concat_ws("|", F.lit("azure"), "account", F.lit("azure:resourcemanager:subscription"), sub_arn), "Subscription", F.col("account"), sub_arn, F.col("account"))
    tree = facts.where("kind = 'mg_hierarchy'")
    groups = tree.select(F.col("source").alias("mg")).union(tree.where(json_text("attributes", "childType") == "managementGroup").select("target")).distinct()
    mg_arn = F.concat(F.lit(GROUPS), F.col("mg"))
    g = made(groups, F.concat_ws("|", F.lit("azure"), F.lit("tenant"), F.lit("azure:management:managementgroup"), mg_arn), "ManagementGroup", F.lit("tenant"), mg_arn, F.col("mg"))
    rgs = own.withColumn("rg", rg_scope_of("arn")).where("rg != ''").groupBy(F.lower("rg").alias("k")).agg(F.min(F.struct("rg", "account")).alias("r"))
    r = made(rgs, F.concat_ws("|", F.lit("azure"), F.col("r.account"), F.lit("azure:resourcemanager:resourcegroup"), F.col("r.rg")), "ResourceGroup", F.col("r.account"), F.col("r.rg"), last_seg("r.rg"))
    return s.unionByName(g).unionByName(r)


def ancestor_scopes(arn: Column) -> Column:
    """All scopes that cover an id by prefix: the root, and every prefix that ends before a slash; lower case."""
    parts = F.split(F.lower(arn), "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("/")), prefixes))


def scope_cover(scopes: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """``(scope, node_id)``: each of ``scopes(scope)`` with the nodes that it covers.

    A management group covers what lies in its subscriptions; one that the hierarchy doesn't know covers everything.
    """
    ids = nodes.where(~blank("arn")).select("node_id", "arn")
    plain = scopes.where(~F.col("scope").startswith(GROUPS)).withColumn("key", F.when(F.col("scope") == "/", F.lit("/")).otherwise(F.lower(F.regexp_replace("scope", "/+$", ""))))
    by_prefix = plain.join(ids.select("node_id", F.explode(ancestor_scopes(F.col("arn"))).alias("key")), "key").select("scope", "node_id")
    groups = scopes.where(F.col("scope").startswith(GROUPS)).withColumn("mg", F.substring("scope", len(GROUPS) + 1, 1 << 20))
    known = closure.select("mg").distinct()
    by_group = groups.join(closure, "mg").join(ids.select("node_id", sub_of("arn").alias("subscription")).where("subscription != ''"), "subscription").select("scope", "node_id")
    unknown = ids.select("node_id").join(small(stored(groups.join(known, "mg", "left_anti").select("scope"), "unknown"))).select("scope", "node_id")
    return by_prefix.unionByName(by_group).unionByName(unknown).distinct()


def _any(patterns: Column, action: Column) -> Column:
    return F.exists(patterns, lambda p: azure_wildcard_match(p, action))


def capabilities(spark) -> DataFrame:
    rows = [(k, edge, action, plane, list(types), kind, weight) for k, (edge, action, plane, types, kind, weight) in enumerate(AZURE_CAPABILITIES)]
    return config_frame(spark, rows, "ord int, edge string, permission string, plane string, types array<string>, kind string, weight double")


def role_action_match(facts: DataFrame) -> DataFrame:
    """``(role, ord)``: the capabilities of each role, settled once for all its assignments."""
    roles = facts.where("kind = 'role_definition'").select(role_def_key("source").alias("role"), _list("actions").alias("a"), _list("notActions").alias("na"), _list("dataActions").alias("d"), _list("notDataActions").alias("nd"))
    caps = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(c[1]).alias("permission"), F.lit(c[2] == "data").alias("data")) for k, c in enumerate(AZURE_CAPABILITIES)])
    fits = lambda c: F.when(c["data"], _any(F.col("d"), c["permission"]) & ~_any(F.col("nd"), c["permission"])).otherwise(_any(F.col("a"), c["permission"]) & ~_any(F.col("na"), c["permission"]))
    return roles.select("role", F.explode(F.filter(caps, fits)).alias("c")).select("role", "c.ord").distinct()


def _denied(facts: DataFrame) -> DataFrame:
    """``(principal, scope, ord)``: the capabilities that deny assignments take from their principals."""
    denies = facts.where("kind = 'deny_assignment'").select(F.col("source").alias("principal"), F.col("target").alias("scope"), _list("actions").alias("a"), _list("notActions").alias("na"))
    caps = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(c[1]).alias("permission")) for k, c in enumerate(AZURE_CAPABILITIES)])
    return denies.select("principal", "scope", F.explode(F.filter(caps, lambda c: _any(F.col("a"), c["permission"]) & ~_any(F.col("na"), c["permission"]))).alias("c")).select("principal", "scope", "c.ord").distinct()


def _denied_cover(hit: DataFrame, nodes: DataFrame) -> DataFrame:
    nothing = hit.sparkSession.createDataFrame([], "mg string, subscription string")
    return scope_cover(hit.select("scope").distinct(), nodes, nothing)


def deny_assignments(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(principal, ord, node_id)`` that some deny assignment of the principal itself covers; a group scope covers everything."""
    hit = _denied(facts)
    return hit.join(_denied_cover(hit, nodes), "scope").select("principal", "ord", "node_id").distinct()


def _rbac_grants(facts: DataFrame, nodes: DataFrame, closure: DataFrame, principals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Role assignments by classes of resources, after deny assignments: the best of each, and the classes' members."""
    assigned = stored(expand_group_assignments(assignments(facts), facts).where(~blank("scope")), "assigned")
    denied = stored(_denied(facts), "denied")
    tagged = lambda tag, c: F.concat(F.lit(tag), c)
    cover = scope_cover(assigned.select("scope").distinct(), nodes, closure).select("node_id", tagged("a", F.col("scope")).alias("key")).unionByName(_denied_cover(denied, nodes).select("node_id", tagged("d", F.col("scope")).alias("key")))
    cover = stored(cover, "cover")
    typed = nodes.select(F.col("node_id").alias("target"), text("arn").alias("scope"), tagged("t", F.coalesce("node_type", F.lit(""))).alias("key"))
    held = typed.join(cover.where("key like 'a%'").select(F.col("node_id").alias("target")).distinct(), "target", "left_semi")
    members, keys = classes(held.unionByName(held.select("target", "scope").distinct().join(cover.withColumnRenamed("node_id", "target"), "target")))
    under = lambda tag, name: keys.where(F.col("key").startswith(tag)).select("class", F.substring("key", 2, 1 << 20).alias(name))
    fits = stored(under("t", "node_type").join(F.broadcast(capabilities(facts.sparkSession)), F.expr("array_contains(types, node_type)")).drop("node_type", "types", "plane").distinct(), "fits")
    by_class = assigned.join(role_action_match(facts), "role").join(small(stored(under("a", "scope"), "scopes")), "scope").join(small(fits), ["class", "ord"])
    taken = denied.join(small(stored(under("d", "scope"), "scopes")), "scope").select("principal", "ord", "class").distinct()
    left = by_class.join(taken, ["principal", "ord", "class"], "left_anti").join(principals, "principal")
    return class_grants(left.select("edge", "source", "class", "kind", "weight", "permission", "ord", "conditional", F.array("fact_id").alias("facts"))), members


def rbac_edges(facts: DataFrame, nodes: DataFrame, closure: DataFrame, principals: DataFrame) -> DataFrame:
    """Role assignments as edges, after deny assignments; CONDITIONAL where every assignment behind has a condition."""
    return class_edges(*_rbac_grants(facts, nodes, closure, principals), "azure", "role-assignment")


def _edges(df: DataFrame, type_: Column, source: Column, target: Column, scope: Column, kind: Column, nature: str, state: Column, confidence: Column, weight: float, facts: Column, evidence: Column) -> DataFrame:
    empty = F.array().cast("array<string>")
    made = df.select(type_.alias("type"), source.alias("source"), target.alias("target"), scope.alias("scope"), kind.alias("relationship_kind"), F.lit(nature).alias("nature"), F.lit("azure").alias("provider"), state.alias("state"), confidence.alias("confidence"), F.lit(weight).alias("weight"), empty.alias("permissions"), empty.alias("conditions"), facts.alias("facts"), evidence.alias("evidence"))
    return made.withColumn("edge_id", edge_id("type", "source", "target", "scope"))


def container_takeover(edges: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Who can grant on a management group controls its subscriptions, on a resource group all that lies in it."""
    grants = edges.where("type = 'CanGrantPermission'").select("source", F.col("target").alias("container"))
    groups = nodes.where("node_type = 'ManagementGroup'").select(F.col("node_id").alias("container"), F.substring("arn", len(GROUPS) + 1, 1 << 20).alias("mg"))
    subs = nodes.where("node_type = 'Subscription'").select("node_id", text("arn").alias("scope"), F.lower("account").alias("subscription"))
    under_group = grants.join(groups, "container").join(closure, "mg").join(subs, "subscription").select("source", "node_id", "scope")
    rgs = nodes.where("node_type = 'ResourceGroup'").select(F.col("node_id").alias("container"), F.lower("arn").alias("key"))
    inside = nodes.where("node_type is null or node_type not in ('ResourceGroup', 'Subscription', 'ManagementGroup')").where(~blank("arn")).select("node_id", text("arn").alias("scope"), F.lower(rg_scope_of("arn")).alias("key")).where("key != ''")
    under_rg = grants.join(rgs, "container").join(inside, "key").where("lower(scope) != key").select("source", "node_id", "scope")
    rows = under_group.unionByName(under_rg).distinct()
    none = F.array().cast("array<string>")
    return _edges(rows, F.lit("CanControl"), F.col("source"), F.col("node_id"), F.col("scope"), F.lit("CONTROL"), "derived", F.lit("ACTIVE"), F.lit(0.9), 2.0, none, F.lit('{"via":"container-takeover"}'))


def expand_group_holders(held: DataFrame, facts: DataFrame) -> DataFrame:
    """Who holds what a principal holds: itself, its members and its owners."""
    members = facts.where("kind = 'member_of'").select(F.col("source").alias("holder"), F.col("target").alias("principal"))
    owners = facts.where("kind = 'entra_group_owner'").select(F.col("source").alias("holder"), F.col("target").alias("principal"))
    through = held.join(members.union(owners).distinct(), "principal").withColumn("principal", F.col("holder")).select(*held.columns)
    return held.unionByName(through)


def _directory(facts: DataFrame, kinds: dict[str, bool], key: str, cfg: tuple, nodes: DataFrame, principals: DataFrame) -> DataFrame:
    spark = facts.sparkSession
    table = config_frame(spark, list(cfg), "template string, edge string, reaches string, kind string")
    rows = facts.where(F.col("kind").isin(*kinds)).select(F.col("source").alias("principal"), F.lower(json_text("attributes", key)).alias("template"), F.col("kind").isin(*[k for k, c in kinds.items() if c]).alias("conditional"), _id().alias("fact_id"))
    held = expand_group_holders(rows, facts).join(F.broadcast(table), "template").join(principals, "principal")
    reach = nodes.select(F.col("node_id").alias("target"), F.col("node_type").alias("reaches"), text("arn").alias("scope"))
    met = held.join(reach, "reaches")
    rows = met.select("edge", "source", "target", "scope", "kind", F.lit(2.0).alias("weight"), F.col("template").alias("permission"), F.lit(0).alias("ord"), "conditional", F.array("fact_id").alias("facts"))
    return dedup_upgrade(rows.select(*GRANTED), "azure", "entra")


def directory_role_edges(facts: DataFrame, nodes: DataFrame, principals: DataFrame) -> DataFrame:
    """Directory roles over the tenant, service principals, people or groups; eligible ones are CONDITIONAL."""
    return _directory(facts, {"entra_role_assignment": False, "entra_role_eligible": True}, "roleTemplateId", DIRECTORY_ROLES, nodes, principals)


def app_role_edges(facts: DataFrame, nodes: DataFrame, principals: DataFrame) -> DataFrame:
    return _directory(facts, {"entra_app_role": False}, "appRoleId", APP_ROLES, nodes, principals)


def owner_edges(facts: DataFrame, principals: DataFrame, nodes: DataFrame) -> DataFrame:
    """Owners of service principals can add credentials, owners of groups members."""
    owned = facts.where("kind in ('entra_owner', 'entra_group_owner')").select(F.col("source").alias("principal"), F.col("target").alias("owned"), (F.col("kind") == "entra_owner").alias("sp"), _id().alias("fact_id"))
    met = owned.join(principals, "principal").join(principals.select(F.col("principal").alias("owned"), F.col("source").alias("target")), "owned").join(nodes.select(F.col("node_id").alias("target"), text("arn").alias("scope")), "target").where("source != target")
    return _edges(met, F.when(F.col("sp"), "CanCreateCredentialFor").otherwise("CanAddMember"), F.col("source"), F.col("target"), F.col("scope"), F.when(F.col("sp"), "CREDENTIAL").otherwise("CONTROL"), "explicit", F.lit("ACTIVE"), F.lit(1.0), 2.0, F.array("fact_id"), F.lit('{"via":"entra"}')).dropDuplicates(["edge_id"])


def internet_exposures(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Resources open to the internet: confirmed public containers, the setting that permits them, public network access."""
    public = facts.where("kind = 'public_container'").select(F.lower("source").alias("key")).distinct().withColumn("confirmed", F.lit(True))
    get = lambda p: F.get_json_object("attributes", f"$.properties.{p}")
    toggle, network = F.coalesce(get("allowBlobPublicAccess") == "true", F.lit(False)), F.coalesce(F.lower(get("publicNetworkAccess")) == "enabled", F.lit(False))
    open_ = F.coalesce(F.lower(get("networkAcls.defaultAction")) == "allow", network)
    met = nodes.join(public, F.lower("arn") == F.col("key"), "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    severity = F.when(toggle & F.col("confirmed"), "critical").when(toggle & open_, "high").when(toggle, "medium").when(network, "high")
    what = F.when(toggle & F.col("confirmed"), "a container is public").when(toggle, "public containers are permitted").otherwise("public network access is enabled")
    rows = met.withColumn("severity", severity).where("severity is not null").withColumn("what", what)
    none = F.array().cast("array<string>")
    return _edges(rows, F.lit("ExposedToInternet"), F.col("node_id"), F.lit(ANONYMOUS), text("arn"), F.lit("NETWORK"), "explicit", F.lit("ACTIVE"), F.lit(1.0), 1.0, none, F.to_json(F.struct(F.col("what").alias("exposure"), "severity")))


def azure_permission_edges(facts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All Azure edges, and the nodes that only facts know: containers, principals, the tenant, the anonymous internet."""
    spark = facts.sparkSession
    closure = stored(mg_closure(facts), "closure")
    containers = stored(container_nodes(facts, nodes), "containers")
    kinds = ("role_assignment", "deny_assignment", "entra_role_assignment", "entra_role_eligible", "entra_app_role", "entra_owner", "entra_group_owner", "member_of", "principal")
    ids = facts.where(F.col("kind").isin(*kinds)).select(F.col("source").alias("principal")).union(facts.where("kind in ('entra_owner', 'entra_group_owner', 'member_of')").select("target"))
    principals, people = resolve_principals(ids, facts, nodes)
    principals = stored(principals, "principals")
    fixed = spark.createDataFrame([(TENANT, "Tenant", "azure", "tenant", "tenant", '{"synthesized":true}'), (ANONYMOUS, "AnonymousIdentity", "azure", "internet", "Anonymous", '{"synthesized":true}')], "node_id string, node_type string, provider string, account string, arn string, attributes string")
    extra = stored(containers.unionByName(people).unionByName(fixed), "extra")
    every = stored(nodes.select("node_id", "node_type", "provider", "account", "arn", "attributes").unionByName(extra), "every")
    best, members = _rbac_grants(facts, every, closure, principals)
    # takeover looks at grants on containers alone: these are written out by themselves, all edges once
    holders = members.join(every.where("node_type in ('ManagementGroup', 'ResourceGroup')").select(F.col("node_id").alias("target")).distinct(), "target", "left_semi")
    granting = best.where("edge = 'CanGrantPermission'").join(holders, "class").where("source != target").select(F.col("edge").alias("type"), "source", "target")
    rbac = class_edges(best, members, "azure", "role-assignment")
    parts = [container_takeover(granting, every, closure), directory_role_edges(facts, every, principals), app_role_edges(facts, every, principals), owner_edges(facts, principals, every), internet_exposures(facts, nodes)]
    edges = rbac
    for p in parts:
        edges = edges.unionByName(p)
    return edges, extra
