"""An access graph derived from the whole sales tables: customers assume suppliers, suppliers assume suppliers and read parts.

Every registered graph query runs on it, so that its work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwarden.functions.scalars import edge_id
from arcwarden.tables import read_table

PART_TYPES = ("Secret", "ObjectStorage", "NoSQLDatabase", "EncryptionKey")


def _id(account, kind: str, key):
    return F.concat_ws("|", F.lit("tpch"), account.cast("string"), F.lit(kind), key.cast("string"))


def access_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, node_type, provider, account, arn, attributes`` of customers, suppliers and parts."""
    customer, supplier, part = (read_table(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    one = lambda df, kind, node_type, account, key: df.select(_id(account, kind, key).alias("node_id"), node_type.alias("node_type"), F.lit("tpch").alias("provider"), account.cast("string").alias("account"))
    types = F.element_at(F.array(*map(F.lit, PART_TYPES)), (F.col("p_partkey") % 4 + 1).cast("int"))
    nodes = (
        one(customer, "demo:crm:customer", F.lit("HumanIdentity"), F.col("c_nationkey"), F.col("c_custkey"))
        .unionByName(one(supplier, "demo:iam:role", F.lit("Role"), F.col("s_nationkey"), F.col("s_suppkey")))
        .unionByName(one(part, "demo:data:part", types, F.col("p_partkey") % 25, F.col("p_partkey")))
    )
    return nodes.select("*", F.lit(None).cast("string").alias("arn"), F.lit(None).cast("string").alias("attributes"))


def _top(df: DataFrame, by: list[str], pick: str, score: str) -> DataFrame:
    """For each group the ``pick`` of the highest score, the smallest one where several have it."""
    return df.groupBy(*by).agg(F.max_by(pick, F.struct(F.col(score), -F.col(pick))).alias(pick))


def access_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit edges: edge_id, type, source, target, scope, state, weight, confidence, nature, provider, relationship_kind.

    From all orders and line items: a customer assumes the supplier of most of its goods (ACTIVE), and that of its largest
    single line (CONDITIONAL, if it is another one); a supplier assumes the one of a quarter of its number; a supplier reads,
    of each type of part, the part that it delivers most.
    """
    customer, supplier, orders, lineitem = (read_table(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "lineitem"))
    s_id = supplier.select("s_suppkey", _id(F.col("s_nationkey"), "demo:iam:role", F.col("s_suppkey")).alias("supplier_id"))
    c_id = customer.select("c_custkey", _id(F.col("c_nationkey"), "demo:crm:customer", F.col("c_custkey")).alias("customer_id"))
    bought = orders.select("o_orderkey", "o_custkey").join(lineitem.select("l_orderkey", "l_suppkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"))
    bought = bought.groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("total"), F.max("l_quantity").alias("largest"))
    mainly = _top(bought, ["o_custkey"], "l_suppkey", "total").withColumn("state", F.lit("ACTIVE"))
    once = _top(bought, ["o_custkey"], "l_suppkey", "largest").withColumn("state", F.lit("CONDITIONAL"))
    chosen = mainly.unionByName(once).groupBy("o_custkey", "l_suppkey").agg(F.min("state").alias("state"))
    assume = chosen.join(c_id, F.col("o_custkey") == F.col("c_custkey")).join(s_id, F.col("l_suppkey") == F.col("s_suppkey"))
    edge = lambda df, type_, source, target, state, weight, confidence, kind: df.select(F.lit(type_).alias("type"), source.alias("source"), target.alias("target"), state.alias("state"), F.lit(weight).alias("weight"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("relationship_kind"))
    to = s_id.select(F.col("s_suppkey").alias("to_key"), F.col("supplier_id").alias("to_id"))
    chain = s_id.withColumn("to_key", F.floor(F.col("s_suppkey") / 4)).join(to, "to_key")
    sold = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("total")).withColumn("part_type", F.col("l_partkey") % 4)
    reads = _top(sold, ["l_suppkey", "part_type"], "l_partkey", "total").join(s_id, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = (
        edge(assume, "CanAssume", F.col("customer_id"), F.col("supplier_id"), F.col("state"), 1.0, 0.9, "AUTHORIZATION")
        .unionByName(edge(chain, "CanAssume", F.col("supplier_id"), F.col("to_id"), F.lit("ACTIVE"), 1.0, 1.0, "AUTHORIZATION"))
        .unionByName(edge(reads, "CanReadData", F.col("supplier_id"), _id(F.col("l_partkey") % 25, "demo:data:part", F.col("l_partkey")), F.lit("ACTIVE"), 2.0, 1.0, "CREDENTIAL"))
    )
    return edges.select(edge_id("type", "source", "target", F.lit("")).alias("edge_id"), "type", "source", "target", F.lit("").alias("scope"), "state", "weight", "confidence", F.lit("explicit").alias("nature"), F.lit("tpch").alias("provider"), "relationship_kind")


#: The same graph for DuckDB, as the head of a WITH clause.
GRAPH_SQL = """
s_id AS (SELECT s_suppkey, 'tpch|' || s_nationkey || '|demo:iam:role|' || s_suppkey AS id FROM supplier),
c_id AS (SELECT c_custkey, 'tpch|' || c_nationkey || '|demo:crm:customer|' || c_custkey AS id FROM customer),
nodes AS (
  SELECT 'tpch|' || c_nationkey || '|demo:crm:customer|' || c_custkey AS node_id, 'HumanIdentity' AS node_type, c_nationkey::VARCHAR AS account FROM customer
  UNION ALL SELECT 'tpch|' || s_nationkey || '|demo:iam:role|' || s_suppkey, 'Role', s_nationkey::VARCHAR FROM supplier
  UNION ALL SELECT 'tpch|' || (p_partkey % 25) || '|demo:data:part|' || p_partkey, ['Secret', 'ObjectStorage', 'NoSQLDatabase', 'EncryptionKey'][p_partkey % 4 + 1], (p_partkey % 25)::VARCHAR FROM part
),
bought AS (SELECT o_custkey, l_suppkey, sum(l_quantity) AS total, max(l_quantity) AS largest FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
chosen AS (SELECT o_custkey, l_suppkey, min(state) AS state FROM (
  SELECT o_custkey, arg_max(l_suppkey, (total, -l_suppkey)) AS l_suppkey, 'ACTIVE' AS state FROM bought GROUP BY o_custkey
  UNION ALL SELECT o_custkey, arg_max(l_suppkey, (largest, -l_suppkey)), 'CONDITIONAL' FROM bought GROUP BY o_custkey) GROUP BY o_custkey, l_suppkey),
sold AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS total FROM lineitem GROUP BY ALL),
raw_edges AS (
  SELECT 'CanAssume' AS type, c.id AS source, s.id AS target, b.state, 1.0::DOUBLE AS weight, 0.9::DOUBLE AS confidence, 'AUTHORIZATION' AS relationship_kind
  FROM chosen b JOIN c_id c ON b.o_custkey = c.c_custkey JOIN s_id s ON b.l_suppkey = s.s_suppkey
  UNION ALL SELECT 'CanAssume', a.id, b.id, 'ACTIVE', 1.0, 1.0, 'AUTHORIZATION' FROM s_id a JOIN s_id b ON b.s_suppkey = a.s_suppkey // 4
  UNION ALL SELECT 'CanReadData', s.id, 'tpch|' || (l.l_partkey % 25) || '|demo:data:part|' || l.l_partkey, 'ACTIVE', 2.0, 1.0, 'CREDENTIAL'
  FROM (SELECT l_suppkey, arg_max(l_partkey, (total, -l_partkey)) AS l_partkey FROM sold GROUP BY l_suppkey, l_partkey % 4) l JOIN s_id s ON l.l_suppkey = s.s_suppkey
),
edges AS (SELECT 'e_' || substr(sha256(type || '|' || source || '|' || target || '|'), 1, 16) AS edge_id, *, '' AS scope, 'explicit' AS nature FROM raw_edges)
"""
