"""Registered queries over the access graph, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwarden.functions import scalars as S
from arcwarden.operators import derive as D
from arcwarden.operators import explore as X
from arcwarden.operators import traverse as T
from arcwarden.plans.access_graph import GRAPH_SQL, access_edges, access_nodes
from arcwarden.tables import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and stored edges of the access graph."""
    return access_nodes(spark, sf_dir), stored(access_edges(spark, sf_dir), "graph")


def query(name: str, sql: str | None = None, recursive: bool = False, head: str = GRAPH_SQL):
    """Register ``fn(nodes, edges)`` as a query over the access graph."""

    def add(fn: Callable[[DataFrame, DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(*graph(spark, sf_dir))
        if sql:
            ORACLE[name] = f"WITH {'RECURSIVE ' if recursive else ''}{head}{sql}"
        return fn

    return add


def first_customer(edges: DataFrame) -> DataFrame:
    """The customer of the smallest id that assumes a supplier."""
    return edges.where("source LIKE '%demo:crm:customer%'").groupBy().agg(F.min("source").alias("node")).where("node is not null")


def last_part(edges: DataFrame) -> DataFrame:
    """The part of the largest id that somebody reads."""
    return edges.where("type = 'CanReadData'").groupBy().agg(F.max("target").alias("node")).where("node is not null")


START = "(SELECT min(source) FROM edges WHERE source LIKE '%demo:crm:customer%')"
GOAL = "(SELECT max(target) FROM edges WHERE type = 'CanReadData')"
PEOPLE = "('HumanIdentity', 'Role')"


def walk(start: str, hops: int, forward: bool = True) -> str:
    """CTE ``walk(node, d)``: nodes by the hops of some way, capped."""
    a, b = ("source", "target") if forward else ("target", "source")
    return f", walk(node, d) AS (SELECT {start}, 0 UNION SELECT e.{b}, w.d + 1 FROM walk w JOIN edges e ON e.{a} = w.node WHERE w.d < {hops})"


def costs(start: str, hops: int) -> str:
    """CTEs ``way(node, d, c)`` and ``cost(node, cost, hops)``: least costs under a hop cap."""
    return f""", way(node, d, c) AS (SELECT {start}, 0, 0.0::DOUBLE UNION SELECT e.target, w.d + 1, w.c + e.weight FROM way w JOIN edges e ON e.source = w.node WHERE w.d < {hops}),
cost AS (SELECT node, min(c) AS cost, arg_min(d, (c, d)) AS hops FROM way GROUP BY node)"""


# Base graph and derivation

query("access_nodes", "SELECT node_id, node_type, account FROM nodes")(lambda n, e: n.select("node_id", "node_type", "account"))
query("access_edges", "SELECT edge_id, type, source, target, state, weight FROM edges")(lambda n, e: e.select("edge_id", "type", "source", "target", "state", "weight"))

_DERIVED = """, r(source, target, w, k) AS (
  SELECT source, target, weight, 2 FROM edges WHERE type = 'CanReadData'
  UNION SELECT a.source, r.target, r.w + 2, least(r.k, CASE a.state WHEN 'ACTIVE' THEN 2 ELSE 1 END) FROM r JOIN edges a ON a.type = 'CanAssume' AND a.target = r.source WHERE r.w < 30
), best AS (
  SELECT source, target, min(w) AS weight, max_by(k, (-w, k)) AS k FROM r GROUP BY source, target
), derived AS (
  SELECT 'e_' || substr(sha256('CanReadData|' || b.source || '|' || b.target || '|'), 1, 16) AS edge_id, 'CanReadData' AS type, b.source, b.target, b.weight, CASE b.k WHEN 2 THEN 'ACTIVE' ELSE 'CONDITIONAL' END AS state
  FROM best b LEFT JOIN edges e ON e.type = 'CanReadData' AND e.source = b.source AND e.target = b.target WHERE e.edge_id IS NULL
)"""


@query("fixpoint", _DERIVED + " SELECT edge_id, type, source, target, weight, state FROM derived", recursive=True)
def _fixpoint(nodes, edges):
    return D.fixpoint(edges, nodes, history=False).select("edge_id", "type", "source", "target", "weight", "state")


@query("join_rules", """ SELECT b.type, a.source, b.target, min(a.weight + b.weight + 1) AS weight, count(*) AS pairs, round(max(least(a.confidence, b.confidence) * 0.95), 6) AS confidence
FROM edges a JOIN edges b ON a.type = 'CanAssume' AND a.target = b.source AND b.type = 'CanReadData' GROUP BY ALL""")
def _join_rules(nodes, edges):
    e = D.normalized(edges)
    return D.join_rules(e, e).groupBy("type", "source", "target").agg(F.min("weight").alias("weight"), F.count("*").alias("pairs"), F.round(F.max("confidence"), 6).alias("confidence"))


@query("compose_fields", """ SELECT a.edge_id || ',' || b.edge_id AS history, 'inherit-via-assume' AS rule_id, CASE WHEN a.state = 'ACTIVE' AND b.state = 'ACTIVE' THEN 'ACTIVE' ELSE 'CONDITIONAL' END AS state,
round(least(a.confidence, b.confidence) * 0.95, 6) AS confidence, b.relationship_kind FROM edges a JOIN edges b ON a.type = 'CanAssume' AND a.target = b.source AND b.type = 'CanReadData'""")
def _compose(nodes, edges):
    e = D.normalized(edges)
    return D.join_rules(e, e).select(F.concat_ws(",", "derived_from").alias("history"), "rule_id", "state", F.round("confidence", 6).alias("confidence"), "relationship_kind")


@query("better_edge", """, dup AS (SELECT type, source, target, weight + k AS weight, CASE WHEN k = 1 THEN 'CONDITIONAL' ELSE state END AS state FROM edges, (VALUES (0), (1)) v(k))
SELECT type, source, target, min(weight) AS weight, arg_min(state, weight) AS state FROM dup GROUP BY ALL""")
def _better(nodes, edges):
    worse = edges.withColumn("weight", F.col("weight") + 1).withColumn("state", F.lit("CONDITIONAL"))
    return D.best_edges(D.normalized(edges.unionByName(worse).withColumn("nature", F.lit("derived")))).select("type", "source", "target", "weight", "state")


@query("promotions", """ SELECT CASE WHEN type = 'CanAssume' THEN 'CanEscalateTo' ELSE 'CanControl' END AS type, source, target, weight, round(confidence * CASE WHEN type = 'CanAssume' THEN 0.9 ELSE 0.85 END, 6) AS confidence FROM edges""")
def _promotions(nodes, edges):
    renamed = edges.withColumn("type", F.when(F.col("type") == "CanAssume", "CanImpersonate").otherwise("CanModify"))
    return D.promotions(D.normalized(renamed.drop("edge_id")), nodes).select("type", "source", "target", "weight", F.round("confidence", 6).alias("confidence"))


@query("account_takeover", """, held AS (SELECT source, split_part(target, '|', 2) AS account, weight FROM edges JOIN nodes ON target = node_id WHERE type = 'CanAssume' AND node_id IN (SELECT min(node_id) FROM nodes WHERE node_type = 'Role' GROUP BY account)),
hit AS (SELECT h.source, n.node_id, n.node_type, h.weight FROM held h JOIN nodes n ON h.account = n.account WHERE n.node_id <> h.source)
SELECT 'CanControl' AS type, source, node_id AS target, min(weight) + 2 AS weight FROM hit GROUP BY ALL
UNION ALL SELECT 'CanEscalateTo', source, node_id, min(weight) + 2 FROM hit WHERE node_type IN ('HumanIdentity', 'Role') GROUP BY ALL""")
def _takeover(nodes, edges):
    """The first role of each account stands for the account's container."""
    firsts = nodes.where("node_type = 'Role'").groupBy("account").agg(F.min("node_id").alias("node_id"))
    retyped = nodes.join(firsts.select("node_id", F.lit(True).alias("first")), "node_id", "left").withColumn("role", F.col("node_type"))
    types = retyped.withColumn("node_type", F.when(F.col("first"), F.lit("Account")).otherwise(F.col("node_type"))).select("node_id", "node_type", "role")
    held = D.normalized(edges.where("type = 'CanAssume'").withColumn("type", F.lit("CanControl")).drop("edge_id"))
    made = D.account_takeover(held, types.select("node_id", "node_type"))
    again = D.account_takeover(held.join(types.where("node_type = 'Account'").select(F.col("node_id").alias("target")), "target", "left_semi"), types.where("role = 'Role' and node_type = 'Account'").select("node_id", "node_type"))
    escalate = again.where("type = 'CanControl'").withColumn("type", F.lit("CanEscalateTo"))
    return made.unionByName(escalate).groupBy("type", "source", "target").agg(F.min("weight").alias("weight"))


@query("derived_chain", """ SELECT 'e_' || substr(sha256('CanReadData|' || a.source || '|' || b.target || '|'), 1, 16) AS edge_id, a.source || ' CanAssume ' || a.target || ' -> ' || b.source || ' CanReadData ' || b.target AS chain
FROM edges a JOIN edges b ON a.type = 'CanAssume' AND a.target = b.source AND b.type = 'CanReadData'
QUALIFY row_number() OVER (PARTITION BY a.source, b.target ORDER BY a.edge_id, b.edge_id) = 1""")
def _chain(nodes, edges):
    e = D.normalized(edges)
    once = D.join_rules(e, e).groupBy("edge_id").agg(F.min("derived_from").alias("derived_from"))
    return D.derived_chain(once, edges).select("edge_id", F.concat_ws(" -> ", "chain").alias("chain"))


# Traversals

query("traversable_edges", " SELECT edge_id, weight FROM edges WHERE state <> 'CONDITIONAL'")(lambda n, e: T.traversable_edges(e, n, conditional=False).select("edge_id", "weight"))
query("reaches", walk(START, 40) + f" SELECT DISTINCT node FROM walk WHERE node <> {START}", True)(lambda n, e: T.reaches(e, first_customer(e)))
query("reached_by", walk(GOAL, 40, False) + f" SELECT DISTINCT node FROM walk WHERE node <> {GOAL}", True)(lambda n, e: T.reached_by(e, last_part(e)))
query("bfs_within", walk(START, 12) + " SELECT DISTINCT node FROM walk", True)(lambda n, e: T.bfs_within(e, first_customer(e), 12))
query("bfs_depth", walk(GOAL, 40, False) + " SELECT node, min(d) AS depth FROM walk GROUP BY node", True)(lambda n, e: T.bfs_depth(e, last_part(e), direction="backward"))
query("shortest_path", costs(START, 40) + " SELECT node, cost, hops, hops AS n_edges FROM cost WHERE node = (SELECT max(w.node) FROM way w WHERE w.node LIKE '%part%')", True)(
    lambda n, e: T.shortest_path(e, first_customer(e), T.bfs_within(e, first_customer(e)).where("node like '%part%'").groupBy().agg(F.max("node").alias("node"))).select("node", "cost", "hops", F.size("edge_ids").alias("n_edges"))
)
query("shortest_bounded", costs(START, 12) + " SELECT node, cost, hops FROM cost JOIN nodes ON node = node_id WHERE node_type = 'Secret' ORDER BY cost, node LIMIT 1", True)(
    lambda n, e: T.shortest_bounded(e, first_customer(e), X.resolve_targets(n, "type:Secret")).select("node", "cost", "hops")
)
query("shortest_to_each", costs(START, 12) + " SELECT node, cost, hops FROM cost JOIN nodes ON node = node_id WHERE node_type = 'Secret'", True)(
    lambda n, e: T.shortest_to_each(e, first_customer(e), X.resolve_targets(n, "type:Secret")).select("node", "cost", "hops")
)

# Explorations

query("explore_all", " SELECT source AS node FROM edges UNION SELECT target FROM edges")(lambda n, e: X.explore_all(e))
query("explore_reachable", walk(START, 12) + ", dep AS (SELECT node, min(d) AS d FROM walk GROUP BY node) SELECT e.edge_id, b.d AS layer FROM edges e JOIN dep a ON e.source = a.node JOIN dep b ON e.target = b.node WHERE b.d = a.d + 1", True)(
    lambda n, e: X.explore_reachable(e, first_customer(e)).select("edge_id", "layer")
)
query("explore_reaches", walk(GOAL, 12, False) + " SELECT edge_id FROM edges WHERE source IN (SELECT node FROM walk) AND target IN (SELECT node FROM walk)", True)(lambda n, e: X.explore_reaches(e, last_part(e)).select("edge_id"))
query("explore_path", walk(START, 12) + f", back(node, d) AS (SELECT node_id, 0 FROM nodes WHERE node_type = 'Secret' UNION SELECT e.source, b.d + 1 FROM back b JOIN edges e ON e.target = b.node WHERE b.d < 12) SELECT edge_id FROM edges WHERE source IN (SELECT node FROM walk) AND target IN (SELECT node FROM back)", True)(
    lambda n, e: X.explore_path(e, first_customer(e), X.resolve_targets(n, "type:Secret")).select("edge_id")
)
query("explore_preset", f", src AS (SELECT node_id FROM nodes WHERE node_type IN {PEOPLE} ORDER BY node_id LIMIT 400), way(start, node, d, c) AS (SELECT node_id, node_id, 0, 0.0::DOUBLE FROM src UNION SELECT w.start, e.target, w.d + 1, w.c + e.weight FROM way w JOIN edges e ON e.source = w.node WHERE w.d < 12), "
      "hit AS (SELECT start, node, min(c) AS cost FROM way JOIN nodes ON node = node_id WHERE node_type IN ('Secret', 'EncryptionKey') GROUP BY start, node) SELECT start, arg_min(node, (cost, node)) AS node, min(cost) AS cost FROM hit GROUP BY start", True)(
    lambda n, e: X.explore_preset(n, e, "high_value").select("start", "node", "cost")
)
query("resolve_targets", " SELECT node_id AS node FROM nodes WHERE node_type = 'Secret'")(lambda n, e: X.resolve_targets(n, "type:Secret"))
query("admin_identities", f" SELECT DISTINCT node_id AS node FROM nodes JOIN edges ON source = node_id WHERE node_type IN {PEOPLE} AND type = 'CanAssume' AND target LIKE '%role|1%'")(
    lambda n, e: X.admin_identities(n, e.withColumn("type", F.lit("MemberOf")).withColumn("target", F.regexp_replace("target", r"role\|1", "role|admin1")).where("relationship_kind = 'AUTHORIZATION'")).select("node")
)
query("graph_node_index", " SELECT node_id, node_type FROM nodes WHERE node_type <> 'Secret' UNION SELECT DISTINCT e.target, 'External' FROM edges e JOIN nodes n ON e.target = n.node_id WHERE n.node_type = 'Secret'")(
    lambda n, e: X.graph_node_index(n.where("node_type != 'Secret'"), e).select("node_id", "node_type")
)
query("node_list", " SELECT node_id AS id, split_part(node_id, '|', 4) AS label, node_type, split_part(node_id, '|', 3) AS kind FROM nodes")(lambda n, e: X.node_list(n).select("id", "label", "node_type", "kind"))
query("node_search", " SELECT node_id AS id, CASE WHEN split_part(node_id, '|', 4) LIKE '17%' THEN 0 WHEN split_part(node_id, '|', 4) LIKE '%17%' THEN 1 ELSE 2 END AS rank FROM nodes WHERE node_id LIKE '%17%' ORDER BY rank, split_part(node_id, '|', 4), id LIMIT 30")(
    lambda n, e: X.node_search(n, "17").select("id", "rank")
)
query("node_detail", " SELECT 'outbound' AS part, type, target AS other_id, n.node_type AS other_type FROM edges JOIN nodes n ON target = n.node_id WHERE source = (SELECT min(source) FROM edges WHERE type = 'CanReadData') UNION ALL SELECT 'inbound', type, source, n.node_type FROM edges JOIN nodes n ON source = n.node_id WHERE target = (SELECT min(source) FROM edges WHERE type = 'CanReadData') AND source <> target")(
    lambda n, e: X.node_detail(n, e, e.where("type = 'CanReadData'").groupBy().agg(F.min("source").alias("node"))).select("part", "type", "other_id", "other_type")
)
query("density_guard", ", ends AS (SELECT source AS x FROM edges UNION SELECT target FROM edges) SELECT (SELECT count(*) FROM ends) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM ends) > 500 OR (SELECT count(*) FROM edges) > 1000 AS too_dense")(lambda n, e: X.density_guard(e))

# Exposures, rankings and reports

_EXPOSED = """, x AS (SELECT *, CASE WHEN type = 'CanAssume' THEN 'cross_account' ELSE 'internet' END AS kind FROM edges)
SELECT DISTINCT kind, source AS node, CASE kind WHEN 'cross_account' THEN 'medium' ELSE 'high' END AS severity FROM x"""


@query("exposures", _EXPOSED)
def _exposures(nodes, edges):
    """Edges taken for cross-account trust and internet exposure."""
    out = edges.withColumn("type", F.when(F.col("type") == "CanAssume", "CrossAccountTrust").otherwise("ExposedToInternet"))
    return X.exposures(nodes, out).select("kind", "node", "severity")


@query("exposure_filter_sort", _EXPOSED.replace("FROM x", "FROM x WHERE kind = 'cross_account'"))
def _exposure_filter(nodes, edges):
    out = edges.withColumn("type", F.when(F.col("type") == "CanAssume", "CrossAccountTrust").otherwise("ExposedToInternet"))
    return X.exposure_filter_sort(X.exposures(nodes, out), kind="cross_account").select("kind", "node", "severity")


@query("triage_join", """, x AS (SELECT DISTINCT source AS node FROM edges WHERE type = 'CanReadData')
SELECT node, 'internet:' || node || ':open to the internet' AS key, CASE WHEN node LIKE '%7' THEN 'closed' ELSE 'open' END AS status FROM x""")
def _triage(nodes, edges):
    items = X.exposures(nodes, edges.where("type = 'CanReadData'").withColumn("type", F.lit("ExposedToInternet")))
    keyed = items.select(X.finding_key(F.col("kind"), F.col("value_ref"), F.col("node"), F.col("label"), F.col("detail")).alias("key"), F.lit("closed").alias("status"), F.lit("").alias("note")).where("key like '%7:open to the internet'")
    return X.triage_join(items, keyed).select("node", "key", "status")


query("report_paths", costs(START, 12) + ", hit AS (SELECT node, cost, hops FROM cost JOIN nodes ON node = node_id WHERE node_type IN ('Secret', 'EncryptionKey') ORDER BY node LIMIT 40) SELECT node, cost, hops FROM hit", True)(
    lambda n, e: X.report_paths(n, e, first_customer(e)).select("node", "cost", "hops")
)
query("rank_footholds", f", seed AS (SELECT node_id FROM nodes WHERE node_type IN {PEOPLE}), w(start, node) AS (SELECT node_id, node_id FROM seed UNION SELECT w.start, e.target FROM w JOIN edges e ON e.source = w.node), "
      "r AS (SELECT start, count(*) AS reaches, count(*) FILTER (node_type IN ('Secret', 'EncryptionKey')) AS crown_jewels FROM w JOIN nodes ON node = node_id GROUP BY start) "
      "SELECT start AS node_id, reaches, crown_jewels FROM r ORDER BY crown_jewels DESC, reaches DESC, split_part(start, '|', 4), start LIMIT 25", True)(
    lambda n, e: X.rank_footholds(n, e).select("node_id", "reaches", "crown_jewels")
)
query("cross_scope_edges", " SELECT edge_id FROM edges WHERE split_part(source, '|', 2) <> split_part(target, '|', 2)")(lambda n, e: X.cross_scope_edges(e).select("edge_id"))
query("escalation_flags", " SELECT edge_id, weight >= 2 AS escalates FROM edges")(lambda n, e: X.escalation_flags(e).select("edge_id", "escalates"))
query("crown_nodes", f" SELECT DISTINCT node_id FROM nodes JOIN edges ON target = node_id WHERE type = 'CanAssume' AND node_type IN {PEOPLE}")(lambda n, e: X.crown_nodes(n, e.withColumn("type", F.lit("CanImpersonate"))))
query("collapse_parallel", ", b AS (SELECT least(source, target) AS a, greatest(source, target) AS b, edge_id, weight + CASE WHEN split_part(source, '|', 2) <> split_part(target, '|', 2) THEN 500 ELSE 0 END AS s FROM edges) SELECT a, b, arg_max(edge_id, (s, edge_id)) AS edge_id, count(*) AS parallel FROM b GROUP BY a, b")(lambda n, e: X.collapse_parallel(e))
query("class_counts", " SELECT CASE WHEN node_type IN ('HumanIdentity', 'Role') THEN 'identity' ELSE 'sensitive' END AS class, count(*) AS n FROM nodes GROUP BY 1")(lambda n, e: X.class_counts(n))
query("cluster_counts", " SELECT split_part(split_part(node_id, '|', 3), ':', 2) AS cluster, count(*) AS n FROM nodes GROUP BY 1")(lambda n, e: X.cluster_counts(n))
query("graph_report", " SELECT 'edge_type' AS part, type AS key, count(*) AS n FROM edges GROUP BY type UNION ALL SELECT 'edge_state', state, count(*) FROM edges GROUP BY state UNION ALL SELECT 'node_type', node_type, count(*) FROM nodes GROUP BY node_type UNION ALL SELECT 'conditional', 'total', count(*) FILTER (state = 'CONDITIONAL') FROM edges")(lambda n, e: X.graph_report(n, e))
query("custody_summary", " SELECT 'tpch' AS provider, 'unknown' AS engine_version, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")(
    lambda n, e: X.custody_summary(n.limit(1).select("provider"), n, e).select("provider", "engine_version", "nodes", "edges")
)
query("resolve_foothold", " SELECT min(node_id) AS node, 1 AS tier FROM nodes WHERE split_part(node_id, '|', 4) = '17'")(lambda n, e: X.resolve_foothold(n, "17"))
query("merge_edges", " SELECT edge_id, 2 AS n_facts FROM edges")(lambda n, e: merged_twice(e))


def merged_twice(edges: DataFrame) -> DataFrame:
    from arcwarden.operators.assembly import merge_edges

    empty = F.array().cast("array<string>")
    one = edges.withColumns({"permissions": empty, "conditions": empty, "facts": F.array(F.concat(F.lit("fact-a-"), "edge_id"))})
    two = one.withColumn("facts", F.array(F.concat(F.lit("fact-b-"), "edge_id"), F.concat(F.lit("fact-a-"), "edge_id")))
    return merge_edges(one.withColumn("seq", F.lit(0)).unionByName(two.withColumn("seq", F.lit(1)))).select("edge_id", F.size("facts").alias("n_facts"))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: footholds of the access graph by what they reach."""
    return X.rank_footholds(*graph(spark, sf_dir))
