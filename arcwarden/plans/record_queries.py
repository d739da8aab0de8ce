"""Registered queries over records and texts: ledger, detection, extraction, evaluators, provenance, de-identification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwarden.functions import scalars as S
from arcwarden.operators import azure as A
from arcwarden.operators import base_graph as B
from arcwarden.operators import detect as T
from arcwarden.operators import export as E
from arcwarden.operators import gcp as G
from arcwarden.operators import ledger as L
from arcwarden.operators import redact as R
from arcwarden.operators.aws import aws_permission_edges
from arcwarden.plans.access_graph import GRAPH_SQL, access_edges, access_nodes
from arcwarden.sources import extract as X
from arcwarden.tables import config_frame, read_table, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SALT = b"salt of the registered queries.."
SCOPE = "named_struct('provider', '{0}', 'account', {1}, 'region', '', 'global', false)"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


# Scalar functions, over the access graph's ids

query("node_parts", f"WITH {GRAPH_SQL} SELECT node_id, split_part(node_id, '|', 4) AS short, account, split_part(node_id, '|', 3) AS kind, CASE WHEN node_type IN ('HumanIdentity', 'Role') THEN 'identity' ELSE 'sensitive' END AS class, false AS admin FROM nodes")(
    lambda s, d: access_nodes(s, d).select("node_id", S.node_short("node_id").alias("short"), S.node_account("node_id").alias("account"), S.kind_of("node_id", "node_type").alias("kind"), S.node_class("node_type").alias("class"), S.is_admin("node_id", "arn").alias("admin"))
)
query("edge_id", f"WITH {GRAPH_SQL} SELECT source, target, type, edge_id FROM edges")(lambda s, d: access_edges(s, d).select("source", "target", "type", S.edge_id("type", "source", "target", F.lit("")).alias("edge_id")))
query("glob_match", "SELECT p_partkey, p_name LIKE '%1_' AS a, p_name LIKE 'p%1%' AS b FROM part")(lambda s, d: read_table(s, d, "part").select("p_partkey", S.glob_match(F.lit("*1?"), "p_name").alias("a"), S.glob_match(F.lit("p*1*"), "p_name").alias("b")))
query("shannon_entropy", "WITH c AS (SELECT page_id, url, unnest(string_split(url, '')) AS ch FROM pages), f AS (SELECT page_id, length(any_value(url)) AS n, ch, count(*) AS k FROM c GROUP BY page_id, ch) SELECT page_id, round(-sum(k / n * log2(k / n)), 6) AS bits FROM f GROUP BY page_id")(
    lambda s, d: read_table(s, d, "pages").select("page_id", F.round(S.shannon_entropy("url"), 6).alias("bits"))
)
query("norm_identity", "SELECT page_id, trim(regexp_replace(split_part(lower(url), '@', 1), '[\\s._/\\\\-]+', ' ', 'g')) AS name FROM pages")(lambda s, d: read_table(s, d, "pages").select("page_id", S.norm_identity("url").alias("name")))

# Detection

_MARKED = "regexp_matches(text, '(?i)AKIA|ASIA|-----BEGIN|PRIVATE KEY|aws_secret_access_key|password|passwd|xoxb-|xoxp-|ghp_|github_pat_|eyJ')"
query("credential_pattern", f"SELECT doc_id, {_MARKED} AS hit FROM documents")(lambda s, d: read_table(s, d, "documents").select("doc_id", T.credential_pattern("text").alias("hit")))
query("fingerprint", "SELECT doc_id, 'sha256:' || substr(sha256('pepper' || text), 1, 16) || ' len=' || octet_length(encode(text)) || ' …' || right(text, 4) AS value_ref FROM documents")(
    lambda s, d: read_table(s, d, "documents").select("doc_id", T.fingerprint("text", "pepper").alias("value_ref"))
)
query("extract_path", "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")(lambda s, d: T.extract_path(read_table(s, d, "events").select("event_id", "props"), "props", "k / missing.x").select("event_id", "value"))


@query("detect_sensitive", f"SELECT doc_id::VARCHAR AS resource_id, 'site-1' AS site_id, 0.75::DOUBLE AS confidence FROM documents UNION ALL SELECT doc_id::VARCHAR, 'site-1', 0.99 FROM documents WHERE {_MARKED}")
def _detect(s, d):
    body = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("Value"), F.lit("plain words here").alias("Note"))).alias("Items")))
    responses = read_table(s, d, "documents").select(F.lit("get").alias("operation"), F.lit("doc").alias("resource_type"), F.col("doc_id").cast("string").alias("resource_id"), body.alias("body"))
    sites = s.createDataFrame([("site-1", "get", "doc", "Items[].<any>", "doc.Items", "secret_value", "CanReadSecret", "high")], "site_id string, operation string, resource_type string, response_path string, location string, location_kind string, emits_hint string, severity string")
    return T.detect_sensitive(responses, sites).select("resource_id", "site_id", "confidence").distinct()


query("classify_identifier", "WITH h AS (SELECT page_id, split_part(url, '/', 3) AS host FROM pages) SELECT page_id, CASE WHEN length(host) - length(replace(host, '.', '')) >= 2 THEN 'hostname' ELSE 'domain' END AS type FROM h")(
    lambda s, d: read_table(s, d, "pages").select("page_id", R.classify_identifier(F.split_part("url", F.lit("/"), F.lit(3))).alias("type"))
)

# Ledger, from the event stream

_STATUS = "CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'empty' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'planned' ELSE 'skipped' END"
_LAST = f"WITH l AS (SELECT user_id::VARCHAR AS task_id, {_STATUS} AS status, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) "


def ledger_events(s, d) -> DataFrame:
    return read_table(s, d, "events").select(F.col("user_id").cast("string").alias("task_id"), "ts", "event_id", F.expr(_STATUS).alias("status"), F.concat(F.lit("svc:s"), (F.col("event_id") % 7).cast("string"), F.lit(":t")).alias("resource_type"), F.concat(F.lit("op"), (F.col("event_id") % 5).cast("string")).alias("operation"), F.lit("surface:x").alias("reason"), F.lit(2).cast("long").alias("count"))


def last_state(s, d) -> DataFrame:
    return L.ledger_state(ledger_events(s, d))


query("ledger_state", _LAST + "SELECT task_id, status, event_id FROM l")(lambda s, d: last_state(s, d).select("task_id", "status", "event_id"))
query("ledger_summary", _LAST + "SELECT status, count(*) AS n FROM l GROUP BY status")(lambda s, d: L.ledger_summary(last_state(s, d)))
query("ledger_integrity", _LAST + "SELECT count(*) FILTER (status IN ('running', 'planned')) AS open, count(*) FILTER (status IN ('running', 'planned')) = 0 AS ok FROM l")(lambda s, d: L.ledger_integrity(last_state(s, d)))
query("resume_todo", _LAST + "SELECT task_id, CASE WHEN status IN ('ok', 'empty', 'denied', 'skipped') THEN 'skipped' ELSE 'planned' END AS status FROM l")(lambda s, d: L.resume_todo(last_state(s, d).select("task_id"), last_state(s, d)).select("task_id", "status"))
query("coverage_report", _LAST + "SELECT 'outcome' AS part, status AS key, count(*) AS n FROM l GROUP BY status UNION ALL SELECT 'errored', 'op' || event_id % 5, count(*) FROM l WHERE status = 'error' GROUP BY 2 UNION ALL SELECT 'skipped', 'surface:*', count(*) FROM l WHERE status = 'skipped' HAVING count(*) > 0 "
      "UNION ALL SELECT 'service', 's' || event_id % 7, 2 * count(*) FROM l WHERE status = 'ok' GROUP BY 2 UNION ALL SELECT 'empty', 'total', count(*) FROM l WHERE status = 'empty' HAVING count(*) > 0")(lambda s, d: L.coverage_report(last_state(s, d)))
query("top_services", "WITH c AS (SELECT 's' || event_id % 7 AS service, 2 * count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, service) AS k FROM c) SELECT service, n FROM r WHERE k <= 3 UNION ALL SELECT '(other)', sum(n) FROM r WHERE k > 3 HAVING count(*) > 0")(lambda s, d: L.top_services(ledger_events(s, d), 3))
query("denied_permissions", "SELECT DISTINCT 'op' || event_id % 5 AS operation FROM events WHERE event_type = 'error'")(lambda s, d: L.denied_permissions(ledger_events(s, d).withColumn("status", F.when(F.col("status") == "error", "denied").otherwise(F.col("status")))))

# Evaluators, over bundles derived from the sales tables


def _facts(df: DataFrame, kind: str, provider: str, source, target, attributes, account="''") -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.lit("").alias("edge_hint"), F.lit(provider).alias("provider"), F.expr(SCOPE.format(provider, account)).alias("scope"), source.alias("source"), target.alias("target"), attributes.alias("attributes"))


def _nodes(df: DataFrame, provider: str, id_, type_: str, account, arn) -> DataFrame:
    return df.select(id_.alias("node_id"), F.lit(type_).alias("node_type"), F.lit(provider).alias("provider"), account.alias("account"), arn.alias("arn"), F.lit(None).cast("string").alias("attributes"))


@query(
    "aws_permission_edges",
    """WITH held AS (SELECT l_suppkey AS s, l_partkey AS p, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT 'CanReadSecret' AS type, 'secretsmanager:GetSecretValue' AS permissions, 'arn:aws:iam::000000000001:role/r' || s AS source, 'arn:aws:secretsmanager:eu:000000000001:secret:p' || p AS target, CASE WHEN q > 40 THEN 'ACTIVE' ELSE 'CONDITIONAL' END AS state FROM held WHERE s IN (SELECT s_suppkey FROM supplier) AND p IN (SELECT p_partkey FROM part) AND s % 5 <> 0""",
)
def _aws(s, d):
    """Suppliers hold secrets of parts they deliver, small deliveries only from some address; every fifth is denied."""
    supplier, part = read_table(s, d, "supplier"), read_table(s, d, "part")
    role, secret = F.concat(F.lit("arn:aws:iam::000000000001:role/r"), F.col("s_suppkey").cast("string")), F.concat(F.lit("arn:aws:secretsmanager:eu:000000000001:secret:p"), F.col("p_partkey").cast("string"))
    nodes = _nodes(supplier, "aws", F.concat(F.lit("aws|1|aws:iam:role|"), role), "Role", F.lit("1"), role).unionByName(_nodes(part, "aws", F.concat(F.lit("aws|1|aws:secretsmanager:secret|"), secret), "Secret", F.lit("1"), secret))
    held = read_table(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    arn = F.concat(F.lit("arn:aws:secretsmanager:eu:000000000001:secret:p"), F.col("l_partkey").cast("string"))
    lists = held.groupBy("l_suppkey").agg(F.collect_list(F.when(F.col("q") > 40, arn)).alias("sure"), F.collect_list(F.when(F.col("q") <= 40, arn)).alias("maybe"))
    read = F.lit("secretsmanager:Get*")
    text = lambda st: F.to_json(st)
    one = lambda name, more: F.when(F.size(name) > 0, F.regexp_replace(text(F.struct(F.lit("Allow").alias("Effect"), read.alias("Action"), F.col(name).alias("Resource"))), r"\}$", more))
    deny = F.when(F.col("l_suppkey") % 5 == 0, F.lit('{"Effect":"Deny","Action":"*","Resource":"*"}'))
    statements = F.array_compact(F.array(one("sure", "}"), one("maybe", ',"Condition":{"IpAddress":{"aws:SourceIp":"10.0.0.0/8"}}}'), deny))
    document = F.concat(F.lit('{"Statement":['), F.array_join(statements, ","), F.lit("]}"))
    facts = _facts(lists, "identity_policy", "aws", F.concat(F.lit("arn:aws:iam::000000000001:role/r"), F.col("l_suppkey").cast("string")), F.lit(""), F.to_json(F.struct(document.alias("document"))), "'000000000001'")
    return aws_permission_edges(facts, nodes).select("type", F.array_join("permissions", ",").alias("permissions"), F.substring_index("source", "|", -1).alias("source"), F.substring_index("target", "|", -1).alias("target"), "state")


@query(
    "gcp_permission_edges",
    """WITH b AS (SELECT DISTINCT o_custkey AS c, n_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT 'gcp|x.example|gcp:iam:user|c' || c || '@x.example' AS source, 'gcp|n' || n || '|gcp:storage:bucket|b' || s_suppkey AS target, t.type FROM b JOIN supplier ON s_nationkey = n, (VALUES ('CanReadData'), ('CanWriteData')) AS t(type)""",
)
def _gcp(s, d):
    """Customers with some order hold a storage role on their nation's project, whose buckets are its suppliers."""
    orders, customer, supplier = (read_table(s, d, t) for t in ("orders", "customer", "supplier"))
    bound = orders.select(F.col("o_custkey").alias("c_custkey")).distinct().join(customer, "c_custkey")
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    bindings = _facts(bound, "iam_binding", "gcp", F.concat(F.lit("user:c"), F.col("c_custkey").cast("string"), F.lit("@x.example")), nation, F.lit('{"role":"roles/store","level":"project","condition":""}'), "concat('n', cast(c_nationkey as string))")
    roles = _facts(config_frame(s, [(1,)], "one int"), "role_permissions", "gcp", F.lit("roles/store"), F.lit(""), F.lit('{"permissions":["storage.objects.get","storage.objects.create"]}'))
    account = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    nodes = _nodes(supplier, "gcp", F.concat_ws("|", F.lit("gcp"), account, F.lit("gcp:storage:bucket"), F.concat(F.lit("b"), F.col("s_suppkey").cast("string"))), "ObjectStorage", account, F.concat(F.lit("//b"), F.col("s_suppkey").cast("string")))
    return G.gcp_permission_edges(bindings.unionByName(roles), nodes)[0].select("source", "target", "type")


def hierarchy(s, d) -> DataFrame:
    """Regions as management groups below a root, nations as their subscriptions."""
    region, nation = read_table(s, d, "region"), read_table(s, d, "nation")
    bag = lambda t: F.lit(f'{{"childType":"{t}"}}')
    name = lambda c: F.concat(F.lit("r"), F.col(c).cast("string"))
    return _facts(region, "mg_hierarchy", "azure", F.lit("root"), name("r_regionkey"), bag("managementGroup")).unionByName(_facts(nation, "mg_hierarchy", "azure", name("n_regionkey"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), bag("subscription")))


def vaults(s, d) -> DataFrame:
    sub, arn = F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("/subscriptions/n"), F.col("s_nationkey").cast("string"), F.lit("/resourceGroups/g"), (F.col("s_suppkey") % 3).cast("string"), F.lit("/vault/v"), F.col("s_suppkey").cast("string"))
    return _nodes(read_table(s, d, "supplier"), "azure", F.concat_ws("|", F.lit("azure"), sub, F.lit("azure:keyvault:vault"), arn), "Secret", sub, arn)


query("mg_closure", "SELECT 'root' AS mg, 'n' || n_nationkey AS subscription FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation")(lambda s, d: A.mg_closure(hierarchy(s, d)))


@query(
    "scope_cover",
    """SELECT '/providers/Microsoft.Management/managementGroups/r' || n_regionkey AS scope, s_suppkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT '/subscriptions/N' || s_nationkey || '/resourceGroups/G1/', s_suppkey FROM supplier WHERE s_suppkey % 3 = 1 AND s_nationkey IN (SELECT n_nationkey FROM nation)""",
)
def _cover(s, d):
    groups = read_table(s, d, "region").select(F.concat(F.lit(A.GROUPS + "r"), F.col("r_regionkey").cast("string")).alias("scope"))
    rgs = read_table(s, d, "nation").select(F.concat(F.lit("/subscriptions/N"), F.col("n_nationkey").cast("string"), F.lit("/resourceGroups/G1/")).alias("scope"))
    cover = A.scope_cover(groups.union(rgs), vaults(s, d), A.mg_closure(hierarchy(s, d)))
    return cover.select("scope", F.regexp_extract("node_id", r"/v([0-9]+)$", 1).try_cast("long").alias("k"))


@query(
    "azure_permission_edges",
    """SELECT c_custkey::VARCHAR AS principal, s_suppkey AS k FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON s_nationkey = a.n_nationkey WHERE c_custkey % 14 <> 0
UNION ALL SELECT c_custkey::VARCHAR, s_suppkey FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN supplier ON s_nationkey = b.n_nationkey WHERE c_custkey % 14 = 0""",
)
def _azure(s, d):
    """Customers read the secrets of their nation's subscription, every fourteenth those of its region's group."""
    customer = read_table(s, d, "customer").join(read_table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    scope = F.when(F.col("c_custkey") % 14 == 0, F.concat(F.lit(A.GROUPS + "r"), F.col("n_regionkey").cast("string"))).otherwise(F.concat(F.lit("/subscriptions/n"), F.col("n_nationkey").cast("string")))
    assigned = _facts(customer, "role_assignment", "azure", F.col("c_custkey").cast("string"), scope, F.lit('{"roleDefinitionId":"/x/reader","condition":""}'))
    role = _facts(config_frame(s, [(1,)], "one int"), "role_definition", "azure", F.lit("/x/reader"), F.lit(""), F.lit('{"actions":[],"notActions":[],"dataActions":["Microsoft.KeyVault/vaults/secrets/getSecret/action"],"notDataActions":[]}'))
    facts = stored(assigned.unionByName(role).unionByName(hierarchy(s, d)), "facts")
    edges, _ = A.azure_permission_edges(facts, vaults(s, d))
    return edges.where("type = 'CanReadSecret'").select(F.substring_index("source", "|", -1).alias("principal"), F.substring_index("target", "/v", -1).try_cast("long").alias("k"))


# Extraction from responses made of orders


def order_responses(s, d) -> DataFrame:
    """A policy response for each customer with orders: a binding of each priority with the orders as members."""
    orders = read_table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.collect_list(F.concat(F.lit("user:o"), F.col("o_orderkey").cast("string"))).alias("members"))
    body = F.to_json(F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target"), F.lit("project").alias("level"), F.col("bindings")))
    return orders.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("role"), "members")).alias("bindings")).select(F.lit("getIamPolicy").alias("op"), F.expr(SCOPE.format("gcp", "cast(o_custkey as string)")).alias("scope"), body.alias("body"))


query("extract_iam_bindings", "SELECT 'user:o' || o_orderkey AS source, 'c' || o_custkey AS target, o_orderpriority AS role FROM orders WHERE o_orderpriority <> ''")(
    lambda s, d: X.extract_iam_bindings(order_responses(s, d)).select("source", "target", F.get_json_object("attributes", "$.role").alias("role"))
)
query("response_items", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey")(lambda s, d: X.response_items(order_responses(s, d), "bindings").groupBy(F.col("scope.account").cast("long").alias("o_custkey")).agg(F.count("*").alias("n")))


@query("merge_scopes", "SELECT 'user:o' || o_orderkey AS source FROM orders WHERE o_orderpriority <> ''")
def _merged(s, d):
    facts = X.extract_iam_bindings(order_responses(s, d))
    return X.merge_scopes([{"facts": facts}, {"facts": facts}])["facts"].select("source")


@query("build_base", """SELECT 'PlacedBy' AS type, 'name|o' || o_orderkey AS source, 'tpch|1|crm|c' || o_custkey AS target, 'AUTHORIZATION' AS relationship_kind FROM orders JOIN customer ON o_custkey = c_custkey""")
def _base(s, d):
    """Orders as facts whose target is an inventory node and whose source is none."""
    customer = read_table(s, d, "customer")
    null = F.lit(None).cast("string")
    inventory = customer.select(F.lit("tpch").alias("provider"), F.lit("1").alias("account"), F.expr(SCOPE.format("tpch", "'1'")).alias("scope"), F.lit("crm").alias("resource_type"), F.lit("HumanIdentity").alias("node_type"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("native_id"), null.alias("arn"), null.alias("attributes"))
    placed = read_table(s, d, "orders").join(customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    facts = _facts(placed, "order", "tpch", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.concat(F.lit("tpch|1|crm|c"), F.col("o_custkey").cast("string")), F.lit("{}")).withColumn("edge_hint", F.lit("PlacedBy"))
    return B.build_base(inventory, facts)[1].select("type", "source", "target", "relationship_kind")


# Provenance and de-identification


@query("edge_fact_provenance", f"""WITH {GRAPH_SQL} SELECT edge_id, 'own' AS tier, 1 AS n FROM edges WHERE type = 'CanReadData'
UNION ALL SELECT 'x' || a.edge_id, 'history', count(*) FROM edges a JOIN edges b ON a.target = b.source AND a.type = 'CanAssume' AND b.type = 'CanReadData' GROUP BY a.edge_id""")
def _provenance(s, d):
    edges = stored(access_edges(s, d), "graph")
    empty = F.array().cast("array<string>")
    reads = edges.where("type = 'CanReadData'").select("edge_id", "source", "target", F.array(F.concat(F.lit("f-"), "edge_id")).alias("facts"), empty.alias("derived_from"))
    below = edges.where("type = 'CanAssume'").select(F.col("edge_id").alias("a"), F.col("target").alias("source")).join(reads.select("source", "edge_id"), "source").groupBy("a").agg(F.collect_list("edge_id").alias("derived_from"))
    derived = below.select(F.concat(F.lit("x"), "a").alias("edge_id"), F.lit("").alias("source"), F.lit("").alias("target"), empty.alias("facts"), "derived_from")
    facts = reads.select(F.col("source").alias("source_ref"), F.col("target").alias("target_ref"), F.lit("never").alias("fact_id")).where("false")
    return E.edge_fact_provenance(reads.unionByName(derived), facts).select("edge_id", "tier", F.size("facts").alias("n"))


query("node_ref_index", f"WITH {GRAPH_SQL}, t AS (SELECT split_part(node_id, '|', 4) AS ref, min(node_id) AS node FROM nodes GROUP BY 1) SELECT node_id AS ref, node_id AS node FROM nodes UNION ALL SELECT ref, node FROM t")(lambda s, d: E.node_ref_index(access_nodes(s, d)))
query("export_records", f"WITH {GRAPH_SQL} SELECT 'manifest' AS kind, 1 AS n UNION ALL SELECT 'node', count(*) FROM nodes UNION ALL SELECT 'edge', count(*) FROM edges")(
    lambda s, d: E.export_records(E.export_manifest(access_nodes(s, d), access_edges(s, d)), access_nodes(s, d), access_edges(s, d)).groupBy("kind").agg(F.count("*").alias("n"))
)
query("register_identifiers", f"WITH {GRAPH_SQL}, r AS (SELECT account AS real, 'aws_account' AS type FROM nodes UNION SELECT split_part(node_id, '|', 4), 'resource' FROM nodes) SELECT real, min(type) AS type FROM r GROUP BY real")(lambda s, d: R.register_identifiers(access_nodes(s, d)))
query("identifier_map", f"WITH {GRAPH_SQL}, r AS (SELECT account AS real FROM nodes UNION SELECT split_part(node_id, '|', 4) FROM nodes) SELECT count(*) AS n, count(*) AS fakes FROM r")(
    lambda s, d: R.identifier_map(R.register_identifiers(access_nodes(s, d)), SALT).agg(F.count("*").alias("n"), F.count_distinct("fake").alias("fakes"))
)


@query("redact_graph", f"WITH {GRAPH_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, 0 AS leaks, 0 AS shape")
def _redact(s, d):
    frames = {"nodes": access_nodes(s, d), "edges": access_edges(s, d)}
    out, audit, _ = R.redact_graph(frames, SALT)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(out["nodes"], "nodes").join(n(out["edges"], "edges")).join(n(audit["leaks"], "leaks")).join(n(audit["shape"], "shape"))


_LOOKS = R.ANY_PATTERN.replace("'", "''")


@query("scrub_text", f"SELECT doc_id, regexp_matches(coalesce(text, ''), '{_LOOKS}') AS changed, 0 AS left_over FROM documents")
def _scrub(s, d):
    """Texts of documents with all that looks like an identifier replaced: which ones changed, and how many identifiers of the mapping are left in them."""
    docs = read_table(s, d, "documents").select("doc_id", "text")
    mapping = R.identifier_map(R.register_texts(docs, "text"), SALT)
    scrubbed = R.scrub_known(docs.withColumn("before", F.col("text")), mapping, ("text",))
    looked = stored(scrubbed.select("doc_id", (S.text("before") != S.text("text")).alias("changed"), R.lookalikes("text").alias("held")), "looked")
    again = looked.select("doc_id", F.explode("held").alias("real")).join(mapping, "real", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
    return looked.join(again, "doc_id", "left").select("doc_id", "changed", F.coalesce("n", F.lit(0)).cast("int").alias("left_over"))


@query("scrub_residual", f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_LOOKS}')) AS looked, regexp_matches(coalesce(text, ''), '{_LOOKS}') AS changed, 0 AS left_over FROM documents")
def _residual(s, d):
    """Texts of documents swept of what looks like an identifier: how much did, which texts changed, and how much of it still stands."""
    docs = read_table(s, d, "documents").select("doc_id", "text")
    looks = R.lookalikes
    swept = stored(R.scrub_residual(docs.withColumn("before", F.col("text")), SALT, "text"), "swept")
    return swept.select("doc_id", F.size(looks("before")).cast("long").alias("looked"), (S.text("before") != S.text("text")).alias("changed"), F.size(F.array_intersect(looks("before"), looks("text"))).alias("left_over"))


#: A customer's nation and region inside longer words, overlapping, and in the other case.
_GLUED = "concat('x', n_name, 'y_', n_name, substr(r_name, 2), ' ', lower(n_name), '/', c_name, r_name, 'N ', substr(n_name, 2), n_name)"


@query("scrub_known", f"""WITH known AS (SELECT n_name AS real, '<n' || n_nationkey || '>' AS fake FROM nation UNION ALL SELECT r_name, '<r' || r_regionkey || '>' FROM region),
subs AS (SELECT list(real || '=' || fake ORDER BY length(real) DESC, real) AS pairs FROM known)
SELECT c_custkey, list_reduce(list_prepend({_GLUED}, pairs), lambda said, pair: replace(said, split_part(pair, '=', 1), split_part(pair, '=', 2))) AS said
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, subs""")
def _known(s, d):
    nation, region = read_table(s, d, "nation"), read_table(s, d, "region")
    mapping = nation.selectExpr("n_name AS real", "concat('<n', n_nationkey, '>') AS fake").unionByName(region.selectExpr("r_name AS real", "concat('<r', r_regionkey, '>') AS fake"))
    people = read_table(s, d, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).join(region, F.expr("n_regionkey = r_regionkey"))
    return R.scrub_known(people.select("c_custkey", F.expr(_GLUED).alias("said")), mapping, ("said",))
