"""Facts out of landed responses: ``raw(op, scope, body)`` with the response as JSON text. Nothing is called."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.functions.scalars import blank, json_text, text
from arcwarden.operators.detect import _walk
from arcwarden.tables import small, stored

FACT = ["kind", "edge_hint", "provider", "scope", "source", "target", "attributes"]


def get(body: Column | str, path: str) -> Column:
    return F.get_json_object(F.col(body) if isinstance(body, str) else body, f"$.{path}")


def items(body: Column | str, path: str) -> Column:
    """Elements of an array as JSON texts; none where there is no array."""
    return F.coalesce(F.from_json(get(body, path), "array<string>"), F.array().cast("array<string>"))


def _op(raw: DataFrame, op: str) -> DataFrame:
    return raw.where(F.col("op") == op)


def _fact(df: DataFrame, kind: str, hint: str, source: Column, target: Column | None = None, provider: str = "aws", **attributes: Column) -> DataFrame:
    bag = F.to_json(F.struct(*[v.alias(k) for k, v in attributes.items()])) if attributes else F.lit("{}")
    return df.select(F.lit(kind).alias("kind"), F.lit(hint).alias("edge_hint"), F.lit(provider).alias("provider"), "scope", source.alias("source"), (target if target is not None else F.lit("")).alias("target"), bag.alias("attributes"))


def _each(raw: DataFrame, column: str, found: Column, **said: Column) -> DataFrame:
    """A row for each element of ``found``, with what the response says of all of them; the response itself, which may hold any number of elements, isn't carried along."""
    return raw.select("scope", *[c.alias(k) for k, c in said.items()], found.alias("_found")).select("scope", *said, F.explode("_found").alias(column))


def _all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def response_items(raw: DataFrame, path: str) -> DataFrame:
    """``raw`` once for each record: the array at a dotted path, all arrays below ``items.*.<name>``, or the response itself."""
    if ".*." in path:
        head, _, tail = path.partition(".*.")
        steps = [*head.split("."), "<any>", *tail.split("."), "[]"]
    else:
        steps = [*path.split("."), "[]"] if path else []
    found = _walk(F.array("body"), steps) if steps else F.array("body")
    return raw.withColumn("record", F.explode(found))


def _object(names: Column, record: Column) -> Column:
    """JSON object of the named top-level fields of a record, those that it has."""
    held = F.from_json(record, "map<string,string>")
    return F.map_filter(F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n, F.try_element_at(held, n)))), lambda k, v: v.isNotNull())


def normalize_inventory(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Artifacts of ``records(resource_type, scope, operation, record)`` by the registry's fields; ``__account`` overrides the account."""
    cfg = registry.select("resource_type", "node_type", F.col("enumerate.id_field").alias("id_field"), F.col("enumerate.arn_field").alias("arn_field"), F.coalesce("enumerate.attributes", F.array().cast("array<string>")).alias("fields"))
    met = records.join(small(stored(cfg, "registry")), "resource_type").withColumn("held", F.from_json("record", "map<string,string>"))
    pick = lambda c: F.try_element_at("held", F.col(c))
    account = F.coalesce(F.try_element_at("held", F.lit("__account")), F.col("scope.account"))
    rows = met.select(F.col("scope.provider").alias("provider"), account.alias("account"), "scope", "resource_type", "node_type", pick("id_field").alias("native_id"), text(pick("arn_field")).alias("arn"), F.to_json(_object(F.col("fields"), F.col("record"))).alias("attributes"), F.array("operation").alias("collected_by"))
    return rows.where(~blank("native_id"))


def enrich_detail(parents: DataFrame, details: DataFrame, bind: dict[str, str], capture: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parents with captured fields of the detail rows bound by ``{detail field: parent attribute}``, and ledger rows of those whose
    binding is empty. Captured fields replace attributes of the same name."""
    keys = {d: json_text("attributes", p) if p not in parents.columns else F.col(p) for d, p in bind.items()}
    keyed = parents.withColumns({f"_k_{d}": k for d, k in keys.items()})
    bound = reduce(lambda a, b: a & b, [~blank(f"_k_{d}") for d in bind])
    side = details.select(*[get("record", d).alias(f"_d_{d}") for d in bind], _object(F.array(*map(F.lit, capture)), F.col("record")).alias("_c"))
    side = side.groupBy(*[f"_d_{d}" for d in bind]).agg(F.max_by("_c", F.to_json("_c")).alias("_c"))
    joined = keyed.join(side, reduce(lambda a, b: a & b, [F.col(f"_k_{d}") == F.col(f"_d_{d}") for d in bind]), "left")
    held = F.from_json(F.coalesce("attributes", F.lit("{}")), "map<string,string>")
    new = F.coalesce(F.col("_c"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(held, lambda k, v: ~F.map_contains_key(new, k)), new)
    rows = joined.withColumn("attributes", F.to_json(merged)).select(*parents.columns)
    skipped = keyed.where(~bound).select("resource_type", F.lit("skipped").alias("status"), F.lit("unresolved_binding").alias("reason"), "native_id")
    return rows, skipped


# Bindings and roles


def extract_iam_bindings(raw: DataFrame, op: str = "getIamPolicy") -> DataFrame:
    """Each member of each binding; ``target`` and ``level`` come with the response."""
    bindings = _each(_op(raw, op), "b", items("body", "bindings"), to=text(get("body", "target")), level=text(get("body", "level"))).withColumn("role", text(get("b", "role"))).where("role != ''")
    rows = _each(bindings, "member", items("b", "members"), to=F.col("to"), level=F.col("level"), role=F.col("role"), condition=text(get("b", "condition.expression")))
    return _fact(rows, "iam_binding", "HasBinding", F.col("member"), F.col("to"), "gcp", role=F.col("role"), condition=F.col("condition"), level=F.col("level"))


def extract_role_permissions(raw: DataFrame, op: str = "getRole") -> DataFrame:
    """Roles and their permissions; roles without any are dropped."""
    rows = _op(raw, op).withColumn("p", items("body", "includedPermissions")).where(F.size("p") > 0)
    return _fact(rows, "role_permissions", "RoleGrants", get("body", "name"), None, "gcp", permissions=F.col("p"))


def extract_role_assignments(raw: DataFrame, op: str = "roleassignments") -> DataFrame:
    rows = _op(raw, op).where(~blank(get("body", "properties.principalId")))
    p = lambda k: text(get("body", f"properties.{k}"))
    return _fact(rows, "role_assignment", "RoleGrants", p("principalId"), p("scope"), "azure", roleDefinitionId=p("roleDefinitionId"), principalType=p("principalType"), condition=p("condition"))


def _flat(key: str) -> Column:
    return F.flatten(F.transform(items("body", "properties.permissions"), lambda p: F.coalesce(F.from_json(F.get_json_object(p, f"$.{key}"), "array<string>"), F.array().cast("array<string>"))))


def extract_role_definitions(raw: DataFrame, op: str = "roledefinitions") -> DataFrame:
    rows = _op(raw, op).where(~blank(get("body", "id")))
    p = lambda k: text(get("body", f"properties.{k}"))
    return _fact(rows, "role_definition", "RoleGrants", get("body", "id"), None, "azure", roleName=p("roleName"), roleType=p("type"), actions=_flat("actions"), notActions=_flat("notActions"), dataActions=_flat("dataActions"), notDataActions=_flat("notDataActions"))


def extract_deny_assignments(raw: DataFrame, op: str = "denyassignments") -> DataFrame:
    rows = _each(_op(raw, op), "who", items("body", "properties.principals"), on=text(get("body", "properties.scope")), actions=_flat("actions"), notActions=_flat("notActions"), name=text(get("body", "properties.denyAssignmentName"))).where(~blank(get("who", "id")))
    return _fact(rows, "deny_assignment", "", get("who", "id"), F.col("on"), "azure", actions=F.col("actions"), notActions=F.col("notActions"), denyAssignmentName=F.col("name"))


# Directory


def extract_directory_facts(raw: DataFrame) -> DataFrame:
    """Directory roles held and eligible, application roles, and owners of service principals, applications and groups.

    Owners of an application own the service principal of the same application id, compared without case.
    """
    held = lambda op, kind, field, out: _fact(_op(raw, op).where(~blank(get("body", "principalId"))), kind, "", get("body", "principalId"), None, "azure", **{out: F.lower(text(get("body", field)))})
    owners = lambda op: _each(_op(raw, op), "owner", F.transform(items("body", "owners"), lambda o: F.get_json_object(o, "$.id")), id=get("body", "id"), app=F.lower(get("body", "appId"))).where(~blank("owner"))
    sps, groups = owners("servicePrincipals").where(~blank("id")), owners("groups").where(~blank("id"))
    ids = _op(raw, "servicePrincipals").where(~blank(get("body", "appId"))).groupBy(F.lower(get("body", "appId")).alias("app")).agg(F.max(get("body", "id")).alias("sp"))
    apps = owners("applications").join(ids, "app")
    return _all(
        held("roleAssignments", "entra_role_assignment", "roleDefinitionId", "roleTemplateId"), held("appRoleAssignedTo", "entra_app_role", "appRoleId", "appRoleId"), held("roleEligibility", "entra_role_eligible", "roleDefinitionId", "roleTemplateId"),
        _fact(sps, "entra_owner", "", F.col("owner"), F.col("id"), "azure"), _fact(apps, "entra_owner", "", F.col("owner"), F.col("sp"), "azure"), _fact(groups, "entra_group_owner", "", F.col("owner"), F.col("id"), "azure"),
    )


def extract_mg_hierarchy(raw: DataFrame, op: str = "managementGroups") -> DataFrame:
    rows = _each(_op(raw, op), "child", items("body", "properties.children"), name=get("body", "name"))
    kind = F.when(F.contains(F.lower(text(get("child", "type"))), F.lit("subscription")), "subscription").otherwise("managementGroup")
    return _fact(rows, "mg_hierarchy", "", F.col("name"), get("child", "name"), "azure", childType=kind)


def extract_public_containers(raw: DataFrame, op: str = "containers") -> DataFrame:
    """Containers of ``body(account, value[])`` whose public access is neither empty nor none."""
    rows = _each(_op(raw, op), "c", items("body", "value"), account=get("body", "account")).withColumn("access", text(get("c", "properties.publicAccess")))
    return _fact(rows.where("access != '' and lower(access) != 'none'"), "public_container", "", F.col("account"), None, "azure", container=text(get("c", "name")), access=F.col("access"))


def extract_principals(raw: DataFrame, op: str = "directoryObjects") -> DataFrame:
    tag = F.lower(text(F.get_json_object("body", "$['@odata.type']")))
    kind = F.when(F.contains(tag, F.lit("serviceprincipal")), "ServicePrincipal").when(F.contains(tag, F.lit("user")), "User").when(F.contains(tag, F.lit("group")), "Group").when(F.contains(tag, F.lit("application")), "Application").otherwise("DirectoryObject")
    g = lambda k: text(get("body", k))
    return _fact(_op(raw, op), "principal", "", g("id"), None, "azure", displayName=g("displayName"), type=kind, appId=g("appId"), upn=g("userPrincipalName"))


def extract_member_of(raw: DataFrame, op: str = "transitiveMembers") -> DataFrame:
    rows = _each(_op(raw, op), "m", F.transform(items("body", "value"), lambda x: F.get_json_object(x, "$.id")), group=text(get("body", "group"))).where(~blank("m"))
    return _fact(rows, "member_of", "", F.col("m"), F.col("group"), "azure")


# Network and documents


def extract_network_rules(raw: DataFrame) -> DataFrame:
    """Ingress of security groups from ranges and groups, peerings, and routes with a gateway."""
    perms = _op(raw, "securityGroups").withColumn("p", F.explode(items("body", "IpPermissions")))
    field = lambda f: lambda x: F.get_json_object(x, f"$.{f}")
    peers = F.concat(*[F.transform(items("p", k), field(f)) for k, f in (("IpRanges", "CidrIp"), ("Ipv6Ranges", "CidrIpv6"), ("UserIdGroupPairs", "GroupId"))])
    rules = _fact(perms.withColumn("peer", F.explode(peers)), "network_rule", "CanReachPort", F.col("peer"), get("body", "GroupId"), protocol=text(get("p", "IpProtocol")), from_port=get("p", "FromPort").cast("int"), to_port=get("p", "ToPort").cast("int"))
    peering = _fact(_op(raw, "peering"), "peering", "PeeredWith", text(get("body", "RequesterVpcInfo.VpcId")), text(get("body", "AccepterVpcInfo.VpcId")))
    first = lambda *ks: F.coalesce(*[F.nullif(get("r", k), F.lit("")) for k in ks])
    routes = _op(raw, "routeTables").withColumn("r", F.explode(items("body", "Routes"))).withColumn("to", first("TransitGatewayId", "VpcPeeringConnectionId", "NatGatewayId", "GatewayId")).where("to is not null")
    return _all(rules, peering, _fact(routes, "route", "RoutesTo", get("body", "RouteTableId"), F.col("to"), destination=text(first("DestinationCidrBlock", "DestinationPrefixListId"))))


def _decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def extract_iam_documents(raw: DataFrame) -> DataFrame:
    """Trust, inline and managed documents (URL-decoded), policies and groups of principals, and boundaries by their document."""
    arn, doc = get("body", "Arn"), _decoded(get("body", "Document"))
    trust = _fact(_op(raw, "roles").where(~blank(get("body", "AssumeRolePolicyDocument"))), "trust_policy", "CanAssume", arn, document=_decoded(get("body", "AssumeRolePolicyDocument")))
    inline = _fact(_op(raw, "inlinePolicies").where(~blank(get("body", "Document"))), "identity_policy", "HasPermission", arn, document=doc)
    managed = _fact(_op(raw, "managedPolicies").where(~blank(get("body", "Document"))), "managed_policy", "HasPermission", arn, document=doc)
    has = _fact(_op(raw, "attachedPolicies").where(~blank(get("body", "PolicyArn"))), "membership", "HasPolicy", arn, get("body", "PolicyArn"))
    member = _fact(_op(raw, "userGroups").where(~blank(get("body", "GroupArn"))), "membership", "MemberOf", arn, get("body", "GroupArn"))
    documents = _op(raw, "managedPolicies").where(~blank(get("body", "Document"))).groupBy(arn.alias("policy")).agg(F.max(doc).alias("doc"))
    bounds = _op(raw, "boundaries").withColumn("policy", get("body", "BoundaryArn")).join(documents, "policy")
    return _all(trust, inline, managed, has, member, _fact(bounds, "permission_boundary", "PermissionBoundary", arn, document=F.col("doc")))


def extract_resource_policies(raw: DataFrame, op: str = "resourcePolicies") -> DataFrame:
    """One shape for every service: ``body(service, arn, policy)``; empty policies are dropped."""
    return _fact(_op(raw, op).where(~blank(get("body", "policy"))), "resource_policy", "ResourcePolicy", get("body", "arn"), None, policy=get("body", "policy"), service=text(get("body", "service")))


def extract_scps(raw: DataFrame, op: str = "organizationPolicies") -> DataFrame:
    source = F.coalesce(F.nullif(get("body", "Arn"), F.lit("")), get("body", "Id"))
    return _fact(_op(raw, op).where(~blank(get("body", "Content"))), "scp", "OrgPolicy", source, None, document=get("body", "Content"))


# Planning and merging


def plan_coverage(registry: DataFrame, scopes: DataFrame) -> DataFrame:
    """Expected tasks of ``registry(resource_type, scope, operation)``: regional types in each region, global types once for each account."""
    spots = scopes.select("provider", "account", "region").distinct()
    tasks = stored(registry.select("resource_type", "scope", "operation"), "registry")
    regional = spots.where(~blank("region")).join(small(tasks.where("scope = 'regional'")))
    globally = spots.select("provider", "account").distinct().join(small(tasks.where("scope != 'regional'"))).withColumn("region", F.lit("global"))
    cols = ["provider", "account", "region", "resource_type", "operation"]
    both = regional.select(*cols).unionByName(globally.select(*cols))
    return both.withColumn("task_id", F.concat_ws("/", F.concat_ws(":", "provider", "account", "region"), "resource_type", "operation"))


def merge_scopes(frames: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Bundles as one: facts and findings once, by their JSON; inventory once by id, the row of the smallest content; ledgers after one another."""

    def joined(name: str) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f[name] for f in frames if name in f])

    out = {}
    for name in {k for f in frames for k in f}:
        df = joined(name)
        if name in ("facts", "findings", "surfaces"):
            df = df.withColumn("_j", F.to_json(F.struct(*df.columns))).dropDuplicates(["_j"]).drop("_j")
        elif name == "inventory":
            key = ["provider", "account", "resource_type", "native_id"]
            rest = [c for c in df.columns if c not in key]
            df = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("_r")).select(*key, "_r.*").select(*df.columns)
        out[name] = df
    return out


def merged_provider(scopes: DataFrame) -> DataFrame:
    """One row: the only provider of the scopes that didn't fail, or ``multi``."""
    kept = scopes.where("coalesce(status, '') != 'failed'")
    return kept.agg(F.when(F.count_distinct("provider") > 1, F.lit("multi")).otherwise(F.max("provider")).alias("provider"), F.count("*").alias("scopes"))
