"""Registered queries over single values: each scalar function and detector on values made of whole tables, with its SQL.

The inputs of a query are expressions that Spark and DuckDB read alike, or a pair where they don't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwarden.functions import scalars as S
from arcwarden.operators import detect as T
from arcwarden.operators import explore as X
from arcwarden.plans.record_queries import _MARKED
from arcwarden.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
Inputs = dict[str, str | tuple[str, str]]


def values(name: str, table: str, key: str, inputs: Inputs, made: Callable[[], dict[str, Column]], wanted: dict[str, str]) -> None:
    """Register ``made`` over the inputs, and ``wanted`` as its SQL."""
    side = lambda k: {c: e if isinstance(e, str) else e[k] for c, e in inputs.items()}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read_table(spark, sf_dir, table).select(key, *[F.expr(e).alias(c) for c, e in side(0).items()])
        return rows.select(key, *[v.alias(c) for c, v in made().items()])

    QUERIES[name] = run
    ORACLE[name] = f"WITH t AS (SELECT {key}, {', '.join(f'{e} AS {c}' for c, e in side(1).items())} FROM {table}) SELECT {key}, {', '.join(f'{e} AS {c}' for c, e in wanted.items())} FROM t"


_ARN = "CASE c_custkey % 4 WHEN 0 THEN concat('arn:aws:iam::', lpad(cast(c_custkey AS string), 12, '0'), ':user/', c_name) WHEN 1 THEN lpad(cast(c_custkey AS string), 12, '0') WHEN 2 THEN concat('arn:aws:', lower(c_mktsegment)) ELSE c_name END"
_NODE = "concat('aws|', cast(c_nationkey AS string), '|', CASE c_custkey % 3 WHEN 0 THEN 'aws:iam:role' WHEN 1 THEN 'plain' ELSE '' END, '|', CASE c_custkey % 5 WHEN 0 THEN concat('path/to:', c_name) WHEN 1 THEN concat('x/service:', c_name) ELSE c_name END)"
_LAST = "{0}[len({0})]"

# Identity keys and parts of identifiers
values("node_id", "customer", "c_custkey", {"a": "cast(c_nationkey AS string)", "m": "nullif(c_mktsegment, 'FURNITURE')", "n": "c_name"}, lambda: {"id": S.node_id(F.lit("tpch"), "a", "m", "n")}, {"id": "'tpch|' || a || '|' || coalesce(m, '') || '|' || n"})
values("fact_id", "customer", "c_custkey", {"m": "nullif(c_mktsegment, 'FURNITURE')", "n": "c_name"}, lambda: {"id": S.fact_id(F.lit("aws"), F.lit("trust"), "n", "m", F.lit("CanAssume"), F.lit("1"))}, {"id": "'fact-' || substr(sha256('aws|trust|' || n || '|' || coalesce(m, '') || '|CanAssume|1'), 1, 12)"})
values("account_of", "customer", "c_custkey", {"a": _ARN}, lambda: {"account": S.account_of("a")}, {"account": "CASE WHEN starts_with(a, 'arn:') THEN split_part(a, ':', 5) WHEN regexp_full_match(a, '[0-9]{12}') THEN a ELSE '' END"})
values("node_account", "customer", "c_custkey", {"i": _NODE}, lambda: {"account": S.node_account("i")}, {"account": "split_part(i, '|', 2)"})
values("native_of", "customer", "c_custkey", {"i": _NODE}, lambda: {"native": S.native_of("i")}, {"native": "split_part(i, '|', 4)"})
values("last_seg", "pages", "page_id", {"u": "concat(split_part(url, '?', 1), CASE page_id % 2 WHEN 0 THEN '/' ELSE '' END)"}, lambda: {"whole": S.last_seg("u"), "trimmed": S.last_seg("u", trim=True)}, {"whole": _LAST.format("string_split(u, '/')"), "trimmed": _LAST.format("string_split(regexp_replace(u, '/$', ''), '/')")})
_TAIL = _LAST.format("string_split(split_part(i, '|', 4), '/')")
values("node_short", "customer", "c_custkey", {"i": _NODE}, lambda: {"short": S.node_short("i")}, {"short": f"CASE WHEN starts_with({_TAIL}, 'service') THEN {_TAIL} ELSE {_LAST.format(f'string_split({_TAIL}, chr(58))')} END"})
values("service_of_resource", "customer", "c_custkey", {"i": _NODE, "a": _ARN}, lambda: {"service": S.service_of_resource("i", "a")}, {"service": "CASE WHEN split_part(i, '|', 3) LIKE '%:%' THEN split_part(split_part(i, '|', 3), ':', 2) ELSE split_part(a, ':', 3) END"})
values("label", "customer", "c_custkey", {"i": "concat('aws|1|k|', c_name)", "b": "CASE c_custkey % 4 WHEN 0 THEN concat('{\"alias\":\"alias/', lower(c_name), '\"}') WHEN 1 THEN concat('{\"displayName\":\"', upper(c_name), '\"}') WHEN 2 THEN '{}' END"}, lambda: {"label": S.label("i", "b")}, {"label": "coalesce(regexp_replace(json_extract_string(b, '$.alias'), '^alias/', ''), json_extract_string(b, '$.displayName'), split_part(i, '|', 4))"})
values("kind_of", "customer", "c_custkey", {"i": _NODE, "t": "nullif(c_mktsegment, 'BUILDING')"}, lambda: {"kind": S.kind_of("i", "t")}, {"kind": "CASE WHEN split_part(i, '|', 3) LIKE '%:%' THEN split_part(i, '|', 3) ELSE coalesce(t, '') END"})
values(
    "cluster_of", "customer", "c_custkey",
    {"i": "CASE c_custkey % 7 WHEN 0 THEN concat('aws|1|aws:s3:bucket|', c_name) WHEN 1 THEN 'arn|arn:aws:lambda:eu:1:f' WHEN 2 THEN concat('name|sg-', c_name) WHEN 3 THEN concat('name|10.0.0.', c_name, '/24') WHEN 4 THEN 'name|service:ec2' ELSE concat('name|', c_name) END", "t": "CASE c_custkey % 3 WHEN 0 THEN 'Role' WHEN 1 THEN 'Topic' ELSE '' END"},
    lambda: {"cluster": S.cluster_of("i", "t")},
    {"cluster": "CASE c_custkey % 7 WHEN 0 THEN 's3' WHEN 1 THEN 'lambda' WHEN 2 THEN 'ec2' WHEN 3 THEN 'network' WHEN 4 THEN 'service-principal' ELSE CASE t WHEN 'Role' THEN 'iam' WHEN 'Topic' THEN 'topic' ELSE 'other' END END"},
)
values("node_class", "orders", "o_orderkey", {"t": "CASE o_orderkey % 6 WHEN 0 THEN 'Everyone' WHEN 1 THEN 'Secret' WHEN 2 THEN 'VirtualMachine' WHEN 3 THEN 'Group' WHEN 4 THEN o_orderpriority END"}, lambda: {"class": S.node_class("t")}, {"class": "CASE WHEN t IN ('Everyone', 'Group') THEN 'identity' WHEN t = 'Secret' THEN 'sensitive' WHEN t = 'VirtualMachine' THEN 'compute' ELSE 'env' END"})
values("is_admin", "customer", "c_custkey", {"i": "concat('aws|1|k|', CASE c_custkey % 5 WHEN 0 THEN 'Ad Min' WHEN 1 THEN 'role/root' WHEN 2 THEN 'arn:root' WHEN 3 THEN 'rooted' ELSE c_name END)", "a": "CASE c_custkey % 2 WHEN 0 THEN 'x' END"}, lambda: {"admin": S.is_admin("i", "a")}, {"admin": "c_custkey % 5 < 3"})
values("endpoint_type", "customer", "c_custkey", {"r": "CASE c_custkey % 4 WHEN 0 THEN concat('10.0.', c_name, '/16') WHEN 1 THEN concat('sg-', c_name) WHEN 2 THEN concat('vpc-', c_name) ELSE c_name END"}, lambda: {"type": S.endpoint_type("r")}, {"type": "['CIDR', 'SecurityGroup', 'VirtualNetwork', 'Unknown'][c_custkey % 4 + 1]"})
_SCOPE = "CASE c_custkey % 3 WHEN 0 THEN concat('/Subscriptions/S', cast(c_custkey AS string), '/ResourceGroups/G', c_name, '/providers/x') WHEN 1 THEN concat('subscriptions/T', cast(c_custkey AS string)) ELSE c_name END"
values("sub_of", "customer", "c_custkey", {"s": _SCOPE}, lambda: {"sub": S.sub_of("s")}, {"sub": "CASE c_custkey % 3 WHEN 0 THEN 's' || c_custkey WHEN 1 THEN 't' || c_custkey ELSE '' END"})
values("rg_scope_of", "customer", "c_custkey", {"s": _SCOPE}, lambda: {"rg": S.rg_scope_of("s")}, {"rg": "CASE c_custkey % 3 WHEN 0 THEN replace(s, '/providers/x', '') ELSE '' END"})
values("role_def_key", "customer", "c_custkey", {"s": _SCOPE}, lambda: {"key": S.role_def_key("s")}, {"key": f"lower({_LAST.format(chr(115) + 'tring_split(s, chr(47))')})"})
_MEMBER = "CASE c_custkey % 6 WHEN 0 THEN concat('user:', c_name, '@x.org') WHEN 1 THEN concat('serviceAccount:', c_name, '@p', cast(c_nationkey AS string), '.iam.gserviceaccount.com') WHEN 2 THEN concat('deleted:user:', c_name) WHEN 3 THEN 'allUsers' WHEN 4 THEN concat('domain:', lower(c_mktsegment), '.org') ELSE 'bare' END"
values("split_member", "customer", "c_custkey", {"m": _MEMBER}, lambda: {"kind": S.split_member("m")["kind"], "value": S.split_member("m")["value"]}, {"kind": "CASE WHEN c_custkey % 6 IN (2, 5) THEN NULL ELSE split_part(m, ':', 1) END", "value": "CASE WHEN c_custkey % 6 IN (2, 5) THEN NULL WHEN m = 'allUsers' THEN '' ELSE regexp_replace(m, '^[^:]*:', '') END"})
values("identity_realm", "customer", "c_custkey", {"m": _MEMBER}, lambda: {"realm": S.identity_realm(F.split_part("m", F.lit(":"), F.lit(1)), F.split_part("m", F.lit(":"), F.lit(2)))}, {"realm": "CASE c_custkey % 6 WHEN 0 THEN 'x.org' WHEN 1 THEN 'p' || regexp_extract(m, '@p([0-9]+)', 1) WHEN 3 THEN 'public' WHEN 4 THEN split_part(m, ':', 2) ELSE 'external' END"})
values("is_provider_managed", "customer", "c_custkey", {"m": "CASE c_custkey % 4 WHEN 0 THEN concat('serviceAccount:service-', cast(c_custkey AS string), '@x.iam.gserviceaccount.com') WHEN 1 THEN 'serviceAccount:1@CloudServices.gserviceaccount.com' WHEN 2 THEN 'a@gcp-sa-pubsub.iam.gserviceaccount.com' ELSE concat('user:', c_name, '@x.org') END"}, lambda: {"managed": S.is_provider_managed("m")}, {"managed": "c_custkey % 4 < 3"})
values("norm_type", "customer", "c_custkey", {"t": "concat('aws:', c_mktsegment, CASE c_custkey % 2 WHEN 0 THEN ':Big-Buckets' ELSE ':Key_Ring' END)"}, lambda: {"norm": S.norm_type("t")}, {"norm": "CASE c_custkey % 2 WHEN 0 THEN 'bigbucket' ELSE 'keyring' END"})
values("map_node_type", "orders", "o_orderkey", {"t": "CASE o_orderkey % 3 WHEN 0 THEN 'Everyone' WHEN 1 THEN o_orderpriority END"}, lambda: {"mapped": S.map_node_type("t")}, {"mapped": "CASE WHEN t = 'Everyone' THEN 'AnonymousIdentity' ELSE t END"})
values("map_nature", "orders", "o_orderkey", {"t": "CASE o_orderkey % 3 WHEN 0 THEN 'derived' WHEN 1 THEN 'other' END"}, lambda: {"mapped": S.map_nature("t")}, {"mapped": "CASE WHEN t = 'derived' THEN 'derived' ELSE 'explicit' END"})

# Patterns, addresses, dates and texts
values("azure_wildcard_match", "part", "p_partkey", {"a": "concat('Microsoft.X/vaults/', p_name, '/read')", "p": "CASE p_partkey % 4 WHEN 0 THEN '*' WHEN 1 THEN 'microsoft.x/*/READ' WHEN 2 THEN 'Microsoft.X/vaults/*widget/*' ELSE 'Microsoft.X/vaults/read' END"}, lambda: {"hit": S.azure_wildcard_match("p", "a")}, {"hit": "CASE p_partkey % 4 WHEN 2 THEN lower(a) LIKE 'microsoft.x/vaults/%widget/%' WHEN 3 THEN false ELSE true END"})
values("expand_policy_vars", "customer", "c_custkey", {"n": "c_name", "p": "replace(CASE c_custkey % 4 WHEN 0 THEN 'home/#{AWS:username}/*' WHEN 1 THEN 'a#{*}b' WHEN 2 THEN 'x/#{aws:other}' ELSE '#{#}{aws:username}' END, '#', '$')"}, lambda: {"made": S._literal(S.expand_policy_vars("p", {"aws:username": F.col("n")})), "star": S.glob_match(S.expand_policy_vars("p", {}), F.lit("a*b")), "run": S.glob_match(S.expand_policy_vars("p", {}), F.lit("axxb"))}, {"made": "CASE c_custkey % 4 WHEN 0 THEN 'home/' || n || '/*' WHEN 1 THEN 'a*b' WHEN 3 THEN '${aws:username}' END", "star": "c_custkey % 4 = 1", "run": "false"})
values("scope_contains", "customer", "c_custkey", {"s": "CASE c_custkey % 5 WHEN 0 THEN '/' WHEN 1 THEN '/Subscriptions/S1/' WHEN 2 THEN '/providers/Microsoft.Management/managementGroups/g' WHEN 3 THEN '' ELSE '/subscriptions/s' END", "i": "concat('/subscriptions/s1/', c_name)"}, lambda: {"inside": S.scope_contains("s", "i")}, {"inside": "c_custkey % 5 < 3"})
values("ip_in_cidr", "orders", "o_orderkey", {"ip": "concat('10.', cast(o_orderkey % 256 AS string), '.', cast(o_custkey % 256 AS string), '.7')", "n": "CASE o_orderkey % 4 WHEN 0 THEN '10.0.0.0/9' WHEN 1 THEN '10.5.0.0/16' WHEN 2 THEN 'fe80::/10' ELSE '10.3.0.7' END"}, lambda: {"inside": S.ip_in_cidr("ip", "n")}, {"inside": "CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 256 < 128 WHEN 1 THEN o_orderkey % 256 = 5 WHEN 2 THEN false ELSE ip = n END"})
values("parse_condition_date", "orders", "o_orderkey", {"d": "CASE o_orderkey % 3 WHEN 0 THEN concat(replace(cast(o_orderdate AS string), ' ', 'T'), 'Z') WHEN 1 THEN cast(o_orderkey * 86400 AS string) ELSE o_orderpriority END", "o": "o_orderdate"}, lambda: {"seconds": F.coalesce(S.parse_condition_date("d").cast("long"), F.lit(-1))}, {"seconds": "CASE o_orderkey % 3 WHEN 0 THEN epoch(o)::BIGINT WHEN 1 THEN o_orderkey * 86400 ELSE -1 END"})
values("b64_text", "customer", "c_custkey", {"n": "c_name", "v": ("CASE c_custkey % 3 WHEN 0 THEN c_name ELSE base64(encode(c_name, 'UTF-8')) END", "CASE c_custkey % 3 WHEN 0 THEN c_name ELSE base64(encode(c_name)) END"), "l": "CASE c_custkey % 2 WHEN 0 THEN 'ec2.UserData' ELSE 'tags' END"}, lambda: {"decoded": S.b64_text("v", "l")}, {"decoded": "CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN n ELSE v END"})
values("preview", "documents", "doc_id", {"t": "text"}, lambda: {"shown": S.preview("t", 40)}, {"shown": "CASE WHEN length(trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g'))) > 40 THEN substr(trim(regexp_replace(t, '\\s+', ' ', 'g')), 1, 40) || '…' ELSE trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g')) END"})
values("finding_key", "customer", "c_custkey", {"k": "c_mktsegment", "v": "CASE c_custkey % 3 WHEN 0 THEN c_name END", "n": "CASE c_custkey % 2 WHEN 0 THEN cast(c_custkey AS string) ELSE '' END"}, lambda: {"key": X.finding_key(F.col("k"), F.col("v"), F.col("n"), F.lit("who"), F.lit("what"))}, {"key": "k || ':' || coalesce(v, nullif(n, ''), 'who') || ':what'"})

# Detection
_TOKENS = """WITH raw AS (SELECT doc_id, source, trim(coalesce(text, '')) AS v FROM documents),
bytes AS (SELECT doc_id, octet_length(encode(v)) AS n, unnest(list_transform(range(0, octet_length(encode(v))), lambda i: substr(hex(encode(v)), 2 * i + 1, 2))) AS b FROM raw WHERE octet_length(encode(v)) >= 20 AND NOT regexp_matches(v, '[ \\t\\r\\n]')),
counts AS (SELECT doc_id, n, count(*) AS k FROM bytes GROUP BY doc_id, n, b), bits AS (SELECT doc_id, -sum(k / n * log2(k / n)) AS h FROM counts GROUP BY doc_id)
"""
QUERIES["looks_like_token"] = lambda s, d: read_table(s, d, "documents").select("doc_id", T.looks_like_token(F.trim(S.text("text"))).alias("token"))
ORACLE["looks_like_token"] = _TOKENS + "SELECT doc_id, coalesce(h > 3.5, false) AS token FROM raw LEFT JOIN bits USING (doc_id)"
QUERIES["assess"] = lambda s, d: read_table(s, d, "documents").select("doc_id", T.assess("text", F.when(F.col("source") == "src0", "secret_value").otherwise("tag")).alias("a")).select("doc_id", "a.hit", "a.confidence")
ORACLE["assess"] = _TOKENS + f""", judged AS (SELECT doc_id, CASE WHEN v = '' THEN 0.0 WHEN {_MARKED.replace('text', 'v')} THEN 0.99 WHEN source = 'src0' THEN 0.75 WHEN h > 3.5 THEN 0.8 ELSE 0.2 END::DOUBLE AS confidence FROM raw LEFT JOIN bits USING (doc_id))
SELECT doc_id, confidence > 0.5 AS hit, confidence FROM judged"""


def _sites(s: SparkSession, d: str) -> DataFrame:
    """A site for each part: its brand is the operation, its type the resource type; every fourth can't be read."""
    return read_table(s, d, "part").select(F.col("p_partkey").cast("string").alias("site_id"), F.col("p_brand").alias("operation"), F.col("p_type").alias("resource_type"), F.when(F.col("p_partkey") % 4 == 0, "manual").otherwise("read_api").alias("access_mode"))


QUERIES["surface_gate"] = lambda s, d: T.surface_gate(_sites(s, d))[0].select("site_id", F.lit("site").alias("part")).unionByName(T.surface_gate(_sites(s, d))[1].select("site_id", F.lit("surface").alias("part")))
ORACLE["surface_gate"] = "SELECT p_partkey::VARCHAR AS site_id, CASE p_partkey % 4 WHEN 0 THEN 'surface' ELSE 'site' END AS part FROM part"


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    """Brands and types of large parts were probed, types of many parts are in the inventory, sites that sell more than others have hits, the largest parts failed."""
    sites, part, lines = _sites(s, d), read_table(s, d, "part"), read_table(s, d, "lineitem")
    responses = part.groupBy("p_brand", "p_type").agg(F.avg("p_size").alias("size")).where("size > 24").select(F.col("p_brand").alias("operation"), F.col("p_type").alias("resource_type"))
    types = part.groupBy("p_type").count()
    listed = types.join(types.agg(F.avg("count").alias("mean"))).where(F.col("count") >= F.col("mean")).select(F.col("p_type").alias("resource_type"))
    sold = lines.groupBy("l_partkey").agg(F.sum("l_quantity").alias("total"))
    most = sold.join(sold.agg(F.avg("total").alias("mean"))).where(F.col("total") > F.col("mean") * 1.2)
    hits = lines.join(most, "l_partkey", "left_semi").select(F.col("l_partkey").cast("string").alias("site_id"))
    errors = part.where("p_size > 45").select(F.col("p_partkey").cast("string").alias("site_id"), F.lit("denied").alias("reason"))
    return T.site_outcomes(sites, responses, listed, hits, errors)


QUERIES["site_outcomes"] = _outcomes
ORACLE["site_outcomes"] = """WITH sold AS (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1), h AS (SELECT l_partkey, n FROM sold WHERE total > 1.2 * (SELECT avg(total) FROM sold)),
probed AS (SELECT p_brand, p_type FROM part GROUP BY ALL HAVING avg(p_size) > 24), types AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), listed AS (SELECT p_type FROM types WHERE n >= (SELECT avg(n) FROM types))
SELECT p.p_partkey::VARCHAR AS site_id, CASE WHEN n > 0 THEN 'ok' WHEN p_size > 45 THEN 'denied' WHEN r.p_brand IS NULL THEN 'no_probe_impl' WHEN p.p_type NOT IN (SELECT p_type FROM listed) THEN 'no_inventory_targets' ELSE 'empty' END AS outcome, coalesce(n, 0) AS n
FROM part p LEFT JOIN h ON p.p_partkey = h.l_partkey LEFT JOIN probed r ON p.p_brand = r.p_brand AND p.p_type = r.p_type WHERE p.p_partkey % 4 <> 0"""
QUERIES["decoded_findings"] = lambda s, d: X.decoded_findings(read_table(s, d, "customer").select("c_custkey", F.base64(F.encode("c_name", "UTF-8")).alias("value"), F.lit("customData").alias("location")), n=12).drop("location")
ORACLE["decoded_findings"] = "SELECT c_custkey, CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 12) || '…' ELSE c_name END AS preview FROM customer"
