"""Registered queries over bundles made of the sales tables: rules, base graph, extraction, files, provenance, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwarden.catalog import CHAIN, PROMOTIONS, RULES, SAME_SOURCE
from arcwarden.operators import assembly as H
from arcwarden.operators import base_graph as B
from arcwarden.operators import derive as D
from arcwarden.operators import export as E
from arcwarden.operators import ledger as L
from arcwarden.plans.access_graph import GRAPH_SQL, access_edges, access_nodes
from arcwarden.plans.record_queries import SCOPE, _facts
from arcwarden.sources import extract as X
from arcwarden.sources import records as R
from arcwarden.tables import read_table, shared_dir, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
WITH_GRAPH = f"WITH {GRAPH_SQL}"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def s_(c: str) -> Column:
    return F.col(c).cast("string")


# Rules and promotions: the access graph's edges retyped, so that each one fires

_ASSUMED, _READ = "type = 'CanAssume' AND source LIKE '%customer%'", "type = 'CanReadData'"
_CHAINED = "type = 'CanAssume' AND source LIKE '%role%'"


def _rule(rule: tuple) -> None:
    """CHAIN: customers' suppliers, then what these read. SAME_SOURCE: a supplier's superior and its parts. SAME_TARGET: customers and suppliers that assume one supplier."""
    rule_id, geometry, first, second, emit, prior, add = rule
    a, b, on = (_ASSUMED, _READ, "a.target = b.source") if geometry == CHAIN else (_CHAINED, _READ, "a.source = b.source") if geometry == SAME_SOURCE else (_ASSUMED, _CHAINED, "a.target = b.target")
    target = "b.source" if geometry not in (CHAIN, SAME_SOURCE) else "b.target"

    def run(s: SparkSession, d: str) -> DataFrame:
        edges = stored(access_edges(s, d), "graph").drop("edge_id")
        left = edges.where(a).withColumn("type", F.explode(F.array(*map(F.lit, first))))
        right = edges.where(b).withColumn("type", F.explode(F.array(*map(F.lit, second))))
        made = D.rule_groups(D.normalized(left), D.normalized(right)).where(F.col("rule_id") == rule_id)
        return made.select("type", "source", "target", "state", "n", "weight", F.round("confidence", 6).alias("confidence"))

    query(
        f"rule_{rule_id.replace('-', '_')}",
        f"""{WITH_GRAPH}, f AS (SELECT unnest({list(first)!r}) AS t), g AS (SELECT unnest({list(second)!r}) AS t)
SELECT {f"'{emit}'" if emit else "g.t"} AS type, a.source, {target} AS target, CASE WHEN a.state = 'ACTIVE' AND b.state = 'ACTIVE' THEN 'ACTIVE' ELSE 'CONDITIONAL' END AS state, count(*) AS n,
min(a.weight + b.weight) + {add} AS weight, round(max(least(a.confidence, b.confidence)) * {prior}, 6) AS confidence
FROM (SELECT * FROM edges WHERE {a}) a JOIN (SELECT * FROM edges WHERE {b}) b ON {on}, f, g
WHERE (a.source, f.t, a.target) <> (b.source, g.t, b.target) GROUP BY ALL""",
    )(run)


def _promotion(promotion: tuple) -> None:
    """All edges retyped to each type that the promotion matches; it looks at their targets' types."""
    name, match, emit, types, prior, kind = promotion

    def run(s: SparkSession, d: str) -> DataFrame:
        edges = access_edges(s, d).drop("edge_id").withColumn("type", F.explode(F.array(*map(F.lit, match))))
        made = D.promotions(D.normalized(edges), access_nodes(s, d)).where(F.col("rule_id") == name)
        return made.select("type", "source", "target", "weight", F.round("confidence", 6).alias("confidence"), "relationship_kind")

    wanted = f"WHERE n.node_type IN ({', '.join(map(repr, types))})" if types else ""
    query(f"promotion_{name.replace('-', '_')}", f"{WITH_GRAPH} SELECT '{emit}' AS type, source, target, weight, round(confidence * {prior}, 6) AS confidence, '{kind}' AS relationship_kind FROM edges JOIN nodes n ON target = n.node_id, (SELECT unnest({list(match)!r})) {wanted}")(run)


for _each in RULES:
    _rule(_each)
for _each in PROMOTIONS:
    _promotion(_each)


@query("tenant_takeover", f"""{WITH_GRAPH}, held AS (SELECT source, weight FROM edges WHERE type = 'CanAssume' AND target = (SELECT min(target) FROM edges WHERE type = 'CanAssume'))
SELECT CASE node_type WHEN 'Secret' THEN 'CanControl' ELSE 'CanEscalateTo' END AS type, source, node_id AS target, weight + 2 AS weight FROM held, nodes WHERE node_type IN ('Secret', 'HumanIdentity', 'Role') AND node_id <> source AND node_id <> (SELECT min(target) FROM edges WHERE type = 'CanAssume')""")
def _tenant(s, d):
    """The supplier of the smallest id stands for the tenant, secrets for its subscriptions."""
    edges, nodes = stored(access_edges(s, d), "graph"), access_nodes(s, d)
    top = edges.where("type = 'CanAssume'").agg(F.min("target").alias("node_id"), F.lit(True).alias("top"))
    types = nodes.join(F.broadcast(top), "node_id", "left").select("node_id", F.when(F.col("top"), "Tenant").when(F.col("node_type") == "Secret", "Subscription").otherwise(F.col("node_type")).alias("node_type"))
    held = D.normalized(edges.where("type = 'CanAssume'").withColumn("type", F.lit("CanControl")).drop("edge_id"))
    return D.tenant_takeover(held, types).select("type", "source", "target", "weight")


# The base graph


def inventory_of(df: DataFrame, provider: str, account: Column, kind: str, node_type: str, native: Column, arn: Column | None = None, attributes: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    return df.select(F.lit(provider).alias("provider"), account.alias("account"), F.struct(F.lit(provider).alias("provider"), account.alias("account"), F.lit("").alias("region"), F.lit(False).alias("global")).alias("scope"), F.lit(kind).alias("resource_type"), F.lit(node_type).alias("node_type"), native.alias("native_id"), (null if arn is None else arn).alias("arn"), (null if attributes is None else attributes).alias("attributes"))


def suppliers(s, d) -> DataFrame:
    """Suppliers as roles; every third has an execution role, its superior."""
    arn = lambda k: F.concat(F.lit("arn:aws:iam::1:role/s"), k.cast("string"))
    role = F.when(F.col("s_suppkey") % 3 == 0, F.to_json(F.struct(arn(F.floor(F.col("s_suppkey") / 4)).alias("role_arn"))))
    return inventory_of(read_table(s, d, "supplier"), "aws", F.lit("1"), "aws:iam:role", "Role", F.concat(F.lit("s"), s_("s_suppkey")), arn(F.col("s_suppkey")), role)


_ROLE = "'aws|1|aws:iam:role|s' || "


@query("nodes_from_inventory", f"SELECT {_ROLE} s_suppkey AS node_id, 'Role' AS node_type FROM supplier")
def _nodes_from(s, d):
    """Every supplier twice, the second time as something else: the first row wins."""
    first, again = suppliers(s, d).withColumn("seq", F.lit(1)), suppliers(s, d).withColumn("seq", F.lit(2)).withColumn("node_type", F.lit("Other"))
    return B.nodes_from_inventory(again.unionByName(first)).select("node_id", "node_type")


def policies(s, d, kind: str, document: Column, table: str = "customer", source: Column | None = None) -> DataFrame:
    df = read_table(s, d, table)
    return _facts(df, kind, "aws", source if source is not None else F.concat(F.lit("arn:aws:iam::7:role/c"), s_("c_custkey")), F.lit(""), F.to_json(F.struct(document.alias("document"))))


def statement(effect: str, principal: str, more: str = "") -> Column:
    return F.expr(f"""concat('{{"Statement":[{{"Sid":"x","Effect":"{effect}","Action":"sts:AssumeRole","Principal":', {principal}, '{more}}}]}}')""")


@query("edges_from_trust", """SELECT CASE c_custkey % 3 WHEN 0 THEN 'service:svc' || c_nationkey ELSE 'arn:aws:iam::' || c_nationkey || ':root' END AS source, 'arn:aws:iam::7:role/c' || c_custkey AS target, CASE c_custkey % 3 WHEN 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, CASE c_custkey % 3 WHEN 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence FROM customer WHERE c_custkey % 3 <> 2""")
def _trust(s, d):
    """Customers as roles that trust a service, their nation's account, or everyone (which makes no edge)."""
    who = """CASE c_custkey % 3 WHEN 0 THEN concat('{"Service":"svc', c_nationkey, '"}') WHEN 1 THEN concat('{"AWS":["arn:aws:iam::', c_nationkey, ':root"]}') ELSE '"*"' END"""
    return B.edges_from_trust(policies(s, d, "trust_policy", statement("Allow", who))).select(F.col("source_ref").alias("source"), F.col("target_ref").alias("target"), "weight", "confidence")


def _resource_policies(s, d) -> DataFrame:
    """Orders as buckets of accounts by priority: open to all, to all under a condition, confined to the own account, to another account, to the own one."""
    source = F.expr("concat('arn:aws:sqs:eu:', lpad(cast(o_custkey % 7 as string), 12, '0'), ':q', o_orderkey)")
    own = "lpad(cast(o_custkey % 7 as string), 12, '0')"
    document = F.expr(f"""concat('{{"Statement":{{"Effect":"Allow","Action":"sqs:Send","Principal":', CASE WHEN o_orderkey % 5 < 3 THEN '"*"' WHEN o_orderkey % 5 = 3 THEN '{{"AWS":"arn:aws:iam::999999999999:root"}}' ELSE concat('{{"AWS":"arn:aws:iam::', {own}, ':root"}}') END,
      CASE o_orderkey % 5 WHEN 1 THEN ',"Condition":{{"IpAddress":{{"aws:SourceIp":"10.0.0.0/8"}}}}' WHEN 2 THEN concat(',"Condition":{{"StringEquals":{{"aws:SourceAccount":"', {own}, '"}}}}') ELSE '' END, '}}}}')""")
    return policies(s, d, "resource_policy", document, "orders", source)


_QUEUE = "'arn:aws:sqs:eu:' || lpad((o_custkey % 7)::VARCHAR, 12, '0') || ':q' || o_orderkey"


@query("edges_from_resource_policy", f"SELECT {_QUEUE} AS source, CASE o_orderkey % 5 WHEN 3 THEN 'arn:aws:iam::999999999999:root' ELSE 'principal:*' END AS target, CASE o_orderkey % 5 WHEN 1 THEN 'CONDITIONAL' ELSE 'ACTIVE' END AS state FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)")
def _resource(s, d):
    return B.edges_from_resource_policy(_resource_policies(s, d)).select(F.col("source_ref").alias("source"), F.col("target_ref").alias("target"), "state")


@query("same_account_confined", f"SELECT {_QUEUE} AS source, o_orderkey % 5 = 2 AS confined FROM orders")
def _confined(s, d):
    from arcwarden.functions.scalars import account_of
    from arcwarden.operators.policy import parse_policy_statements

    rows = parse_policy_statements(_resource_policies(s, d))
    return rows.select("source", B.same_account_confined(F.col("conditions"), account_of("source")).alias("confined"))


def placed(s, d) -> DataFrame:
    """Orders as facts of three kinds, every fourth without a target."""
    df = read_table(s, d, "orders")
    facts = _facts(df, "order", "tpch", F.concat(F.lit("o"), s_("o_orderkey")), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("sg-"), s_("o_custkey"))).otherwise(""), F.to_json(F.struct(s_("o_custkey").alias("port"))))
    return facts.withColumn("edge_hint", F.lit("PlacedBy")).withColumn("kind", F.expr("CASE cast(substr(source, 2) as long) % 3 WHEN 0 THEN 'network_rule' WHEN 1 THEN 'membership' ELSE 'order' END"))


_KIND = "CASE o_orderkey % 3 WHEN 0 THEN 'NETWORK' WHEN 1 THEN 'STRUCTURAL' ELSE 'AUTHORIZATION' END"
query("edges_direct", f"SELECT 'o' || o_orderkey AS source, 'sg-' || o_custkey AS target, {_KIND} AS relationship_kind, 'port:' || o_custkey AS permission FROM orders WHERE o_orderkey % 4 <> 0")(
    lambda s, d: B.edges_direct(placed(s, d)).select(F.col("source_ref").alias("source"), F.col("target_ref").alias("target"), "relationship_kind", F.col("permissions")[0].alias("permission"))
)
query("edges_executes_as", f"SELECT {_ROLE} s_suppkey AS source, 'arn:aws:iam::1:role/s' || s_suppkey // 4 AS target FROM supplier WHERE s_suppkey % 3 = 0")(
    lambda s, d: B.edges_executes_as(suppliers(s, d)).select(F.col("source_ref").alias("source"), F.col("target_ref").alias("target"))
)


@query("resolve_endpoints", f"""SELECT 'edge' AS part, {_ROLE} s_suppkey AS id, coalesce({_ROLE} (SELECT max(k.s_suppkey) FROM supplier k WHERE k.s_suppkey = supplier.s_suppkey // 4), 'arn|arn:aws:iam::1:role/s' || s_suppkey // 4) AS other FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'edge', 'name|o' || o_orderkey, 'name|sg-' || o_custkey FROM orders WHERE o_orderkey % 4 <> 0
UNION ALL SELECT 'node', 'name|o' || o_orderkey, 'Unknown' FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT DISTINCT 'node', 'name|sg-' || o_custkey, 'SecurityGroup' FROM orders WHERE o_orderkey % 4 <> 0""")
def _resolve(s, d):
    inventory = stored(suppliers(s, d), "inventory")
    refs = B.edges_executes_as(inventory).unionByName(B.edges_direct(placed(s, d)))
    edges, made = B.resolve_endpoints(refs, B.nodes_from_inventory(inventory), B.arn_index(inventory))
    return edges.select(F.lit("edge").alias("part"), F.col("source").alias("id"), F.col("target").alias("other")).unionByName(made.select(F.lit("node"), "node_id", "node_type").toDF("part", "id", "other"))


@query("build_stats", """SELECT 'explicit_edges' AS part, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'skipped_facts', count(*) FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT 'synthetic_nodes', count(DISTINCT x) FROM (SELECT 'o' || o_orderkey AS x FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'sg-' || o_custkey FROM orders WHERE o_orderkey % 4 <> 0)""")
def _stats(s, d):
    facts = stored(placed(s, d), "facts")
    nodes, edges = B.build_base(suppliers(s, d).where("false"), facts)
    return B.build_stats(facts, nodes, edges)


query("partition_by_provider", "SELECT 'o' || o_orderkey AS source FROM orders WHERE o_orderkey % 3 < 2")(
    lambda s, d: H.partition_by_provider(placed(s, d).withColumn("provider", F.expr("CASE cast(substr(source, 2) as long) % 3 WHEN 0 THEN 'aws' WHEN 1 THEN '' ELSE 'gcp' END")), "aws").select("source")
)


@query("mark_footholds", """SELECT 'aws|1|aws:iam:role|s' || s_suppkey AS node_id, s_suppkey % 2 = 0 AS foothold FROM supplier UNION ALL SELECT 'gcp|p' || n_nationkey || '|gcp:iam:service-account|x@p' || n_nationkey || '.iam.gserviceaccount.com', true FROM nation""")
def _foothold(s, d):
    """Suppliers of even number call, by name or arn, and an unknown service account of each nation."""
    supplier = read_table(s, d, "supplier").where("s_suppkey % 2 = 0")
    callers = supplier.select(F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("s"), s_("s_suppkey"))).otherwise(F.concat(F.lit("arn:aws:iam::1:role/s"), s_("s_suppkey"))).alias("caller"))
    mail = read_table(s, d, "nation").select(F.concat(F.lit("x@p"), s_("n_nationkey"), F.lit(".iam.gserviceaccount.com")).alias("caller"))
    return H.mark_footholds(B.nodes_from_inventory(suppliers(s, d)), callers.union(mail)).select("node_id", "foothold")


query("vocab_conformance", f"{WITH_GRAPH} SELECT 'edge_type' AS part, 'CanReadData' AS name, count(*) AS n FROM edges WHERE type = 'CanReadData' UNION ALL SELECT 'node_type', node_type, count(*) FROM nodes WHERE node_type NOT IN ('Role', 'Secret') GROUP BY node_type")(
    lambda s, d: H.vocab_conformance(access_edges(s, d), access_nodes(s, d), access_edges(s, d).where("type = 'CanAssume'").select(F.col("type").alias("name")).distinct(), access_nodes(s, d).where("node_type in ('Role', 'Secret')").select(F.col("node_type").alias("name")).distinct())
)


@query("assemble_graph", """SELECT 'ExecutesAs' AS type, 'explicit' AS nature, count(*) AS n FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'CanAssume', 'explicit', count(*) FROM supplier
UNION ALL SELECT 'CanExecuteAs', 'derived', count(*) FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'CanEscalateTo', 'derived', count(*) FROM supplier WHERE s_suppkey % 3 = 0""")
def _assemble(s, d):
    """Suppliers as roles that their nation's identity may assume, some of which execute as their superior: base graph, evaluators and derivation in one."""
    supplier = read_table(s, d, "supplier")
    who = """concat('{"AWS":"person', s_suppkey, '"}')"""
    trust = policies(s, d, "trust_policy", statement("Allow", who), "supplier", F.concat(F.lit("arn:aws:iam::1:role/s"), s_("s_suppkey")))
    nodes, edges = H.assemble_graph(suppliers(s, d), trust)
    return edges.groupBy("type", "nature").agg(F.count("*").alias("n"))


# Extraction: responses made of the tables, as some other system would have landed them


def raw(df: DataFrame, op: str, body: Column) -> DataFrame:
    return df.select(F.lit(op).alias("op"), F.expr(SCOPE.format("x", "'1'")).alias("scope"), body.alias("body"))


def obj(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*[(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]))


def js(expression: str) -> Column:
    """A JSON text by a Spark SQL expression."""
    return F.expr(expression)


def bag(key: str) -> Column:
    return F.get_json_object("attributes", f"$.{key}").alias(key)


query("extract_role_permissions", "SELECT 'c' || o_custkey AS source, to_json(list(o_orderpriority ORDER BY o_orderkey)) AS permissions FROM orders GROUP BY o_custkey")(
    lambda s, d: X.extract_role_permissions(raw(read_table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l")), "getRole", obj(name="concat('c', o_custkey)", includedPermissions="transform(l, x -> x.o_orderpriority)"))).select("source", bag("permissions"))
)
query("extract_role_assignments", "SELECT 'p' || c_custkey AS source, '/subscriptions/' || c_nationkey AS target, 'def/' || c_mktsegment AS \"roleDefinitionId\" FROM customer WHERE c_custkey % 4 <> 0")(
    lambda s, d: X.extract_role_assignments(raw(read_table(s, d, "customer"), "roleassignments", js("""to_json(named_struct('properties', named_struct('principalId', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('p', c_custkey) END, 'scope', concat('/subscriptions/', c_nationkey), 'roleDefinitionId', concat('def/', c_mktsegment))))"""))).select("source", "target", bag("roleDefinitionId"))
)
_PERMISSIONS = "array(named_struct('actions', array(concat('a', p_size), p_type), 'notActions', array('n')), named_struct('actions', array(p_brand), 'notActions', array()))"
query("extract_role_definitions", """SELECT '/x/' || p_partkey AS source, '["a' || p_size || '","' || p_type || '","' || p_brand || '"]' AS actions, '["n"]' AS "notActions" FROM part""")(
    lambda s, d: X.extract_role_definitions(raw(read_table(s, d, "part"), "roledefinitions", js(f"to_json(named_struct('id', concat('/x/', p_partkey), 'properties', named_struct('roleName', p_name, 'permissions', {_PERMISSIONS})))"))).select("source", bag("actions"), bag("notActions"))
)
query("extract_deny_assignments", "SELECT 'p' || p_partkey || x AS source, '/s/' || p_size AS target FROM part, (VALUES ('a'), ('b')) AS v(x)")(
    lambda s, d: X.extract_deny_assignments(raw(read_table(s, d, "part"), "denyassignments", js(f"to_json(named_struct('properties', named_struct('scope', concat('/s/', p_size), 'permissions', {_PERMISSIONS}, 'principals', array(named_struct('id', concat('p', p_partkey, 'a')), named_struct('id', concat('p', p_partkey, 'b')), named_struct('id', '')))))"))).select("source", "target")
)


@query("extract_directory_facts", """SELECT 'entra_role_assignment' AS kind, 'p' || c_custkey AS source, 'role' || lower(c_mktsegment) AS other FROM customer UNION ALL SELECT 'entra_owner', 'o' || s_nationkey, 'sp' || s_suppkey FROM supplier
UNION ALL SELECT 'entra_owner', 'dev' || s_suppkey, 'sp' || s_suppkey FROM supplier UNION ALL SELECT 'entra_group_owner', 'boss' || n_regionkey, 'g' || n_nationkey FROM nation""")
def _directory(s, d):
    """Customers hold roles, suppliers are service principals with an owner, and applications with a developer, nations are groups."""
    supplier = read_table(s, d, "supplier")
    rows = (
        raw(read_table(s, d, "customer"), "roleAssignments", obj(principalId="concat('p', c_custkey)", roleDefinitionId="concat('ROLE', c_mktsegment)"))
        .unionByName(raw(supplier, "servicePrincipals", js("to_json(named_struct('id', concat('sp', s_suppkey), 'appId', concat('APP', s_suppkey), 'owners', array(named_struct('id', concat('o', s_nationkey)))))")))
        .unionByName(raw(supplier, "applications", js("to_json(named_struct('appId', concat('app', s_suppkey), 'owners', array(named_struct('id', concat('dev', s_suppkey)))))")))
        .unionByName(raw(read_table(s, d, "nation"), "groups", js("to_json(named_struct('id', concat('g', n_nationkey), 'owners', array(named_struct('id', concat('boss', n_regionkey)))))")))
    )
    return X.extract_directory_facts(rows).select("kind", "source", F.when(F.col("target") == "", F.get_json_object("attributes", "$.roleTemplateId")).otherwise(F.col("target")).alias("other"))


query("extract_mg_hierarchy", "SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, CASE n_nationkey % 2 WHEN 0 THEN 'subscription' ELSE 'managementGroup' END AS \"childType\" FROM nation")(
    lambda s, d: X.extract_mg_hierarchy(raw(read_table(s, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.expr("named_struct('name', concat('n', n_nationkey), 'type', CASE n_nationkey % 2 WHEN 0 THEN '/Subscriptions' ELSE 'mg' END)")).alias("l")), "managementGroups", js("to_json(named_struct('name', concat('r', n_regionkey), 'properties', named_struct('children', l)))"))).select("source", "target", bag("childType"))
)
query("extract_public_containers", "SELECT 'acc' || l_suppkey AS source, l_orderkey || '-' || l_linenumber AS container, l_returnflag AS access FROM lineitem WHERE l_returnflag <> 'N'")(
    lambda s, d: X.extract_public_containers(raw(read_table(s, d, "lineitem").groupBy("l_suppkey").agg(F.collect_list(F.expr("named_struct('name', concat(l_orderkey, '-', l_linenumber), 'properties', named_struct('publicAccess', CASE l_returnflag WHEN 'N' THEN 'None' ELSE l_returnflag END))")).alias("l")), "containers", js("to_json(named_struct('account', concat('acc', l_suppkey), 'value', l))"))).select("source", bag("container"), bag("access"))
)
query("extract_principals", "SELECT 'id' || c_custkey AS source, c_name AS \"displayName\", ['User', 'Group', 'ServicePrincipal', 'DirectoryObject'][c_custkey % 4 + 1] AS type FROM customer")(
    lambda s, d: X.extract_principals(raw(read_table(s, d, "customer"), "directoryObjects", js("""to_json(map('id', concat('id', c_custkey), 'displayName', c_name, '@odata.type', CASE c_custkey % 4 WHEN 0 THEN '#graph.User' WHEN 1 THEN '#graph.group' WHEN 2 THEN '#graph.servicePrincipal' ELSE 'x' END))"""))).select("source", bag("displayName"), bag("type"))
)
query("extract_member_of", "SELECT 'id' || c_custkey AS source, 'g' || c_nationkey AS target FROM customer")(
    lambda s, d: X.extract_member_of(raw(read_table(s, d, "customer").groupBy("c_nationkey").agg(F.collect_list(F.expr("named_struct('id', concat('id', c_custkey))")).alias("l")), "transitiveMembers", js("to_json(named_struct('group', concat('g', c_nationkey), 'value', l))"))).select("source", "target")
)


@query("extract_network_rules", """SELECT 'CanReachPort' AS edge_hint, x AS source, 'sg-' || s_suppkey AS target FROM supplier, (VALUES ('10.0.0.0/8'), ('::/0'), ('sg-peer')) AS v(x)
UNION ALL SELECT 'PeeredWith', 'vpc-' || n_nationkey, 'vpc-r' || n_regionkey FROM nation UNION ALL SELECT 'RoutesTo', 'rtb-' || s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'nat-' ELSE 'igw-' END || s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0""")
def _network(s, d):
    supplier = read_table(s, d, "supplier")
    rows = (
        raw(supplier, "securityGroups", js("""concat('{"GroupId":"sg-', s_suppkey, '","IpPermissions":[{"IpProtocol":"tcp","FromPort":1,"ToPort":2,"IpRanges":[{"CidrIp":"10.0.0.0/8"}],"Ipv6Ranges":[{"CidrIpv6":"::/0"}],"UserIdGroupPairs":[{"GroupId":"sg-peer"}]}]}')"""))
        .unionByName(raw(read_table(s, d, "nation"), "peering", js("""concat('{"RequesterVpcInfo":{"VpcId":"vpc-', n_nationkey, '"},"AccepterVpcInfo":{"VpcId":"vpc-r', n_regionkey, '"}}')""")))
        .unionByName(raw(supplier, "routeTables", js("""concat('{"RouteTableId":"rtb-', s_suppkey, '","Routes":[{"DestinationCidrBlock":"0.0.0.0/0"', CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN concat(',"NatGatewayId":"nat-', s_suppkey, '","GatewayId":"x"') ELSE concat(',"NatGatewayId":"","GatewayId":"igw-', s_suppkey, '"') END, '}]}')""")))
    )
    return X.extract_network_rules(rows).select("edge_hint", "source", "target")


@query("extract_iam_documents", """SELECT 'trust_policy' AS kind, 'arn:r' || s_suppkey AS source, '' AS target, '{"a":"b c"}' AS document FROM supplier UNION ALL SELECT 'membership', 'arn:r' || s_suppkey, 'arn:p' || s_nationkey, NULL FROM supplier
UNION ALL SELECT 'managed_policy', 'arn:p' || n_nationkey, '', '{"n":' || n_regionkey || '}' FROM nation UNION ALL SELECT 'permission_boundary', 'arn:r' || s_suppkey, '', '{"n":' || n_regionkey || '}' FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _documents(s, d):
    supplier = read_table(s, d, "supplier")
    rows = (
        raw(supplier, "roles", obj(Arn="concat('arn:r', s_suppkey)", AssumeRolePolicyDocument="'%7B%22a%22%3A%22b%20c%22%7D'"))
        .unionByName(raw(supplier, "attachedPolicies", obj(Arn="concat('arn:r', s_suppkey)", PolicyArn="concat('arn:p', s_nationkey)")))
        .unionByName(raw(read_table(s, d, "nation"), "managedPolicies", obj(Arn="concat('arn:p', n_nationkey)", Document="""concat('{"n":', n_regionkey, '}')""")))
        .unionByName(raw(supplier, "boundaries", obj(Arn="concat('arn:r', s_suppkey)", BoundaryArn="concat('arn:p', s_nationkey)")))
    )
    return X.extract_iam_documents(rows).select("kind", "source", "target", bag("document"))


query("extract_resource_policies", "SELECT 'arn:' || p_partkey AS source, p_name AS policy, p_brand AS service FROM part WHERE p_partkey % 3 <> 0")(
    lambda s, d: X.extract_resource_policies(raw(read_table(s, d, "part"), "resourcePolicies", obj(service="p_brand", arn="concat('arn:', p_partkey)", policy="CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END")).where(F.trim(F.get_json_object("body", "$.policy")) != "")).select("source", bag("policy"), bag("service"))
)
query("extract_scps", "SELECT CASE p_partkey % 2 WHEN 0 THEN 'arn:' ELSE 'id' END || p_partkey AS source, p_name AS document FROM part WHERE p_partkey % 3 <> 0")(
    lambda s, d: X.extract_scps(raw(read_table(s, d, "part"), "organizationPolicies", obj(Arn="CASE p_partkey % 2 WHEN 0 THEN concat('arn:', p_partkey) ELSE '' END", Id="concat('id', p_partkey)", Content="CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END"))).select("source", bag("document"))
)


def _registry(s, d) -> DataFrame:
    """A resource type for each brand and type of parts, with the fields of its records."""
    types = read_table(s, d, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("resource_type"), F.col("p_type").alias("node_type"), F.when(F.col("p_type") == "ECONOMY", "global").otherwise("regional").alias("scope"), F.lit("list").alias("operation")).distinct()
    return types.withColumn("enumerate", F.expr("named_struct('operation', 'list', 'id_field', 'key', 'arn_field', 'arn', 'attributes', array('size', 'name'))")).withColumn("required_permissions", F.array(F.concat(F.lit("read:"), "node_type"), F.concat(F.lit("list:"), "node_type")))


query("normalize_inventory", """SELECT CASE p_partkey % 5 WHEN 0 THEN 'other' ELSE '1' END AS account, p_brand || ':' || p_type AS resource_type, 'k' || p_partkey AS native_id, CASE p_partkey % 2 WHEN 0 THEN 'arn:' || p_partkey ELSE '' END AS arn, p_size::VARCHAR AS size, p_name AS name FROM part""")(
    lambda s, d: X.normalize_inventory(read_table(s, d, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("resource_type"), F.expr(SCOPE.format("x", "'1'")).alias("scope"), F.lit("list").alias("operation"), js("to_json(map_filter(map('key', concat('k', p_partkey), 'arn', CASE p_partkey % 2 WHEN 0 THEN concat('arn:', p_partkey) END, 'size', cast(p_size as string), 'name', p_name, '__account', CASE p_partkey % 5 WHEN 0 THEN 'other' END), (k, v) -> v is not null))").alias("record")), _registry(s, d)).select("account", "resource_type", "native_id", "arn", bag("size"), bag("name"))
)


@query("enrich_detail", """SELECT 'row' AS part, 'o' || o_orderkey AS native_id, c_name AS owner, o_orderpriority AS priority FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderkey % 4 <> 0
UNION ALL SELECT 'skipped', 'o' || o_orderkey, 'unresolved_binding', NULL FROM orders WHERE o_orderkey % 4 = 0""")
def _enrich(s, d):
    """Orders, with their customer's name; every fourth names no customer."""
    parents = read_table(s, d, "orders").select(F.lit("order").alias("resource_type"), F.concat(F.lit("o"), s_("o_orderkey")).alias("native_id"), js("to_json(named_struct('who', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE cast(o_custkey as string) END, 'priority', o_orderpriority, 'owner', 'nobody'))").alias("attributes"))
    details = read_table(s, d, "customer").select(obj(key="cast(c_custkey as string)", owner="c_name").alias("record"))
    rows, skipped = X.enrich_detail(parents, details, {"key": "who"}, ["owner"])
    owner = F.nullif(F.get_json_object("attributes", "$.owner"), F.lit("nobody"))
    return rows.select(F.lit("row").alias("part"), "native_id", owner.alias("owner"), bag("priority")).unionByName(skipped.select(F.lit("skipped").alias("part"), "native_id", F.col("reason").alias("owner"), F.lit(None).cast("string").alias("priority")))


query("plan_coverage", """WITH t AS (SELECT DISTINCT p_brand || ':' || p_type AS r, p_type FROM part), c AS (SELECT DISTINCT c_nationkey::VARCHAR AS a, c_mktsegment AS g FROM customer)
SELECT 'x:' || a || ':' || g || '/' || r || '/list' AS task_id FROM t, c WHERE p_type <> 'ECONOMY' UNION ALL SELECT 'x:' || a || ':global/' || r || '/list' FROM t, (SELECT DISTINCT a FROM c) WHERE p_type = 'ECONOMY'""")(
    lambda s, d: X.plan_coverage(_registry(s, d), read_table(s, d, "customer").select(F.lit("x").alias("provider"), s_("c_nationkey").alias("account"), F.col("c_mktsegment").alias("region"))).select("task_id")
)
query("required_permissions", "SELECT DISTINCT k || p_type AS permission FROM part, (VALUES ('read:'), ('list:')) AS v(k)")(lambda s, d: L.required_permissions(_registry(s, d)))


# Files: bundles written as newline-delimited JSON into the shared folder, and read again


def folder(s: SparkSession, what: str) -> str:
    return f"{shared_dir(s)}/arcwarden-{what}-{uuid.uuid4().hex}"


def ndjson(s: SparkSession, df: DataFrame, what: str, below: str, broken: bool = False) -> str:
    """The rows of ``df`` as JSON lines under ``below``, in files that end in ``.ndjson``; ``broken`` adds lines that are no JSON."""
    path = folder(s, what)
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines = lines.unionByName(lines.select(F.lit("{broken").alias("value"))) if broken else lines
    lines.write.option("compression", "none").text(f"{path}/{below}")
    hadoop = s.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(f"{path}/{below}")
    fs = root.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), hadoop(f"{path}/{below}/{name.removesuffix('.txt')}.ndjson"))
    return path


query("read_inventory", f"SELECT 's' || s_suppkey AS native_id, 'arn:aws:iam::1:role/s' || s_suppkey AS arn, '1' AS account FROM supplier")(lambda s, d: R.read_inventory(s, ndjson(s, suppliers(s, d), "bundle", "inventory")).select("native_id", "arn", "scope.account"))
query("read_facts", "SELECT 'o' || o_orderkey AS source, 'PlacedBy' AS edge_hint, '{\"port\":\"' || o_custkey || '\"}' AS attributes FROM orders")(lambda s, d: R.read_facts(s, ndjson(s, placed(s, d), "bundle", "facts")).select("source", "edge_hint", "attributes"))


def hits(s, d) -> DataFrame:
    return read_table(s, d, "part").select(s_("p_partkey").alias("site_id"), F.col("p_name").alias("resource_id"), F.col("p_type").alias("severity"), (F.col("p_size") > 20).alias("found"), F.col("p_brand").alias("access_mode"))


query("read_findings", "SELECT p_partkey::VARCHAR AS site_id, p_type AS severity, p_size > 20 AS found FROM part")(lambda s, d: R.read_findings(s, ndjson(s, hits(s, d), "bundle", "exposure/hits.ndjson", True)).select("site_id", "severity", "found"))
query("read_surfaces", "SELECT p_partkey::VARCHAR AS site_id, p_brand AS access_mode FROM part")(lambda s, d: R.read_surfaces(s, ndjson(s, hits(s, d), "bundle", "exposure/surfaces.ndjson", True)).select("site_id", "access_mode"))
query("read_ledger", "SELECT event_id::VARCHAR AS task_id, event_type AS status, user_id AS count FROM events")(lambda s, d: R.read_ledger(s, ndjson(s, read_table(s, d, "events").select(s_("event_id").alias("task_id"), F.col("event_type").alias("status"), F.col("user_id").alias("count")), "bundle", "ledger.ndjson", True)).select("task_id", "status", "count"))


@query("read_manifest", "SELECT 'tpch' AS provider, count(*) AS scopes, true AS integrity_ok FROM nation")
def _manifest(s, d):
    path = folder(s, "bundle")
    scopes = read_table(s, d, "nation").agg(F.collect_list(F.struct(F.lit("tpch").alias("provider"), s_("n_nationkey").alias("account"))).alias("scopes"))
    scopes.select(F.lit("tpch").alias("provider"), "scopes", F.lit(True).alias("integrity_ok")).coalesce(1).write.json(f"{path}/manifest.json")
    return R.read_manifest(s, path).select("provider", F.size("scopes").cast("long").alias("scopes"), "integrity_ok")


@query("read_records", f"{WITH_GRAPH} SELECT 'node' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'edge', count(*) FROM edges UNION ALL SELECT 'finding', count(*) FROM part UNION ALL SELECT 'other', count(*) FROM region")
def _mixed(s, d):
    """Nodes, edges and findings that don't say what they are, and regions, which are none of these."""
    lines = lambda df: df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    path = folder(s, "records")
    mixed = lines(access_nodes(s, d)).union(lines(access_edges(s, d))).union(lines(hits(s, d).drop("access_mode"))).union(lines(read_table(s, d, "region"))).union(read_table(s, d, "nation").select(F.lit("no json")))
    mixed.write.text(path)
    return R.read_records(s, path).groupBy("kind").agg(F.count("*").alias("n"))


def _written(s, df: DataFrame, what: str) -> str:
    """One value as one file."""
    path = folder(s, what)
    df.coalesce(1).write.text(path)
    return path


@query("read_registry", "SELECT DISTINCT p_brand || ':' || p_type AS resource_type, p_type AS node_type, 'key' AS id_field FROM part")
def _read_registry(s, d):
    entry = F.struct(F.col("resource_type").alias("k"), F.struct("node_type", "scope", "enumerate", "required_permissions").alias("v"))
    whole = _registry(s, d).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return R.read_registry(s, _written(s, whole, "registry")).select("resource_type", "node_type", "enumerate.id_field")


@query("read_exposure_sites", "SELECT p_brand AS service, p_partkey::VARCHAR AS id, p_type AS severity FROM part")
def _read_sites(s, d):
    sites = read_table(s, d, "part").groupBy(F.concat(F.lit("prov:"), "p_brand").alias("k")).agg(F.struct(F.collect_list(F.struct(s_("p_partkey").alias("id"), F.col("p_type").alias("severity"))).alias("sites")).alias("v"))
    whole = sites.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("services"))).alias("value"))
    return R.read_exposure_sites(s, _written(s, whole, "sites")).select("service", "id", "severity")


@query("read_vocab", "SELECT DISTINCT p_type AS class, p_brand AS name FROM part")
def _read_vocab(s, d):
    lists = read_table(s, d, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("names"))
    return R.read_vocab(s, _written(s, lists.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("p_type", "names"))).alias("types"))).alias("value")), "vocab"), "types")


@query("write_graph", f"{WITH_GRAPH} SELECT 'nodes' AS part, 2 * count(*) AS n FROM nodes UNION ALL SELECT 'edges', 2 * count(*) FROM edges")
def _write_graph(s, d):
    """Written twice, the second time in addition; a third, fresh run elsewhere replaces what lies there."""
    path = folder(s, "graph")
    nodes, edges = access_nodes(s, d), stored(access_edges(s, d), "graph")
    R.write_graph(path, edges, nodes, fmt="json")
    R.write_graph(path, nodes, edges)
    R.write_graph(path, nodes, edges, resume=True)
    return s.read.parquet(f"{path}/nodes").agg(F.count("*").alias("n")).select(F.lit("nodes").alias("part"), "n").unionByName(s.read.parquet(f"{path}/edges").agg(F.count("*").alias("n")).select(F.lit("edges").alias("part"), "n"))


query("write_manifest", f"{WITH_GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, 0 AS paths")(lambda s, d: R.write_manifest(folder(s, "manifest"), access_nodes(s, d), access_edges(s, d)))


@query("export_findings", "SELECT 'credential' AS kind, p_name AS node, p_type AS severity, p_partkey::VARCHAR AS value_ref FROM part WHERE p_size > 20")
def _export(s, d):
    path = folder(s, "leaks")
    rows = read_table(s, d, "part").select(F.when(F.col("p_size") > 20, "credential").otherwise("public").alias("kind"), F.col("p_name").alias("node"), F.col("p_type").alias("severity"), F.lit("x").alias("detail"), s_("p_partkey").alias("value_ref"))
    R.export_findings(rows, "leaks", path)
    return s.read.option("header", True).csv(path).select("kind", "node", "severity", "value_ref")


# Provenance


def reads(s, d) -> DataFrame:
    """Reading edges as facts about suppliers' short names and parts' ids."""
    edges = access_edges(s, d).where("type = 'CanReadData'")
    return edges.select(F.lit("aws:data-reads").alias("kind"), F.lit("").alias("edge_hint"), F.lit("tpch").alias("provider"), F.expr(SCOPE.format("tpch", "'1'")).alias("scope"), F.concat(F.lit("x/"), F.substring_index("source", "|", -1)).alias("source"), "target")


query("resolve_ref", "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'n|' || c_name WHEN 1 THEN 'n|' || c_name ELSE 'unknown' END AS node FROM customer")(
    lambda s, d: E.resolve_ref(read_table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.expr("CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN concat('path/', c_name) ELSE 'unknown' END").alias("r")), "r", read_table(s, d, "customer").select(F.col("c_name").alias("ref"), F.concat(F.lit("n|"), "c_name").alias("node")), "node").select("k", "node")
)


def tasks(s, d) -> DataFrame:
    return read_table(s, d, "events").select(F.when(F.col("event_id") % 5 != 0, s_("user_id")).otherwise("").alias("task_id"), F.col("event_type").alias("operation"), F.concat(F.lit("data:"), F.when(F.col("event_id") % 2 == 0, "Read").otherwise("Tables")).alias("resource_type"), F.lit("ok").alias("status"), F.col("ts").alias("ended_at"))


query("ledger_evidence", "SELECT count(*) AS tasks, count(DISTINCT user_id) AS n FROM (SELECT user_id FROM events WHERE event_id % 5 <> 0)")(
    lambda s, d: E.ledger_evidence(tasks(s, d)).where("evidence_id like 'ev:op-%'").agg(F.count("*").alias("n")).join(tasks(s, d).where("task_id != ''").agg(F.count("*").alias("tasks"))).select("tasks", "n")
)
_FACT = "'fact-' || substr(sha256('tpch|aws:data-reads|x/' || split_part(source, '|', 4) || '|' || target || '||1'), 1, 12)"
query("fact_records", f"{WITH_GRAPH}, own AS (SELECT split_part(node_id, '|', 4) AS ref, min(node_id) AS node FROM nodes GROUP BY 1) SELECT {_FACT} AS fact_id, node AS source_ref, target AS target_ref FROM edges JOIN own ON ref = split_part(source, '|', 4) WHERE type = 'CanReadData'")(
    lambda s, d: E.fact_records(reads(s, d), access_nodes(s, d)).select("fact_id", "source_ref", "target_ref")
)


@query("fact_evidence_link", f"{WITH_GRAPH} SELECT {_FACT} AS fact_id, 'ev:' || n_nationkey AS evidence_id FROM edges, nation WHERE type = 'CanReadData' AND n_nationkey % 2 = 0")
def _linked(s, d):
    """Evidence of each nation, every second of which is about reading."""
    evidence = read_table(s, d, "nation").select(F.concat(F.lit("ev:"), s_("n_nationkey")).alias("evidence_id"), F.when(F.col("n_nationkey") % 2 == 0, "Data-Reads").otherwise("tables").alias("resource_type"))
    return E.fact_evidence_link(E.fact_records(reads(s, d), access_nodes(s, d)), evidence)


@query("edge_evidence", f"""{WITH_GRAPH} SELECT edge_id, 'ev:' || split_part(source, '|', 2) AS evidence FROM edges WHERE type = 'CanReadData'
UNION ALL SELECT edge_id, 'ev:sha256-' || substr(sha256(CASE state WHEN 'ACTIVE' THEN 'seen' ELSE 'rule:r' END), 1, 16) FROM edges WHERE type = 'CanAssume'""")
def _edge_evidence(s, d):
    """Reading edges have a fact with evidence; of the others some have inline evidence, some are derived."""
    edges = stored(access_edges(s, d), "graph").withColumn("evidence", F.when(F.col("state") == "ACTIVE", "seen")).withColumn("nature", F.when(F.col("state") == "ACTIVE", "explicit").otherwise("derived")).withColumn("rule_id", F.lit("r"))
    own = edges.where("type = 'CanReadData'")
    provenance = own.select("edge_id", F.array(F.concat(F.lit("f"), "edge_id")).alias("facts"))
    linked = own.select(F.concat(F.lit("f"), "edge_id").alias("fact_id"), F.concat(F.lit("ev:"), F.split_part("source", F.lit("|"), F.lit(2))).alias("evidence_id"))
    return E.edge_evidence(edges, provenance, linked).select("edge_id", F.array_join("evidence", ",").alias("evidence"))


query("export_manifest", f"{WITH_GRAPH} SELECT '1.0' AS spec_version, 'tpch' AS providers, (SELECT min(node_id) FROM nodes) AS foothold, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")(
    lambda s, d: E.export_manifest(access_nodes(s, d), access_edges(s, d), access_nodes(s, d).agg(F.min("node_id").alias("node"))).select("spec_version", F.array_join("providers", ",").alias("providers"), "foothold", "nodes", "edges")
)
