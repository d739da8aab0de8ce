"""Registered queries over the stages of the three permission models and of de-identification, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwarden.operators import aws as W
from arcwarden.operators import azure as A
from arcwarden.operators import gcp as G
from arcwarden.operators import policy as P
from arcwarden.operators import redact as R
from arcwarden.operators.grants import dedup_upgrade
from arcwarden.plans.access_graph import GRAPH_SQL, access_edges, access_nodes
from arcwarden.plans.record_queries import SALT, _facts, _nodes
from arcwarden.tables import read_table, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(fn: Query) -> Query:
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return add


def s_(c: str) -> Column:
    return F.col(c).cast("string")


# Statement model: suppliers are roles of account 1 (of 2, if their number is odd), parts are secrets and keys

ROLE = "concat('arn:aws:iam::00000000000', cast(s_suppkey % 2 + 1 as string), ':role/r', cast(s_suppkey as string))"
SECRET = "concat('arn:aws:secretsmanager:eu:000000000001:secret:p', cast(p_partkey as string))"
KEY = "concat('arn:aws:kms:eu:000000000001:key/p', cast(p_partkey as string))"


def roles(s, d) -> DataFrame:
    role = F.expr(ROLE)
    return _nodes(read_table(s, d, "supplier"), "aws", F.concat(F.lit("aws|1|aws:iam:role|"), role), "Role", F.lit("1"), role)


def secrets(s, d) -> DataFrame:
    arn = F.expr(SECRET)
    return _nodes(read_table(s, d, "part"), "aws", F.concat(F.lit("aws|1|aws:secretsmanager:secret|"), arn), "Secret", F.lit("1"), arn)


def keys(s, d) -> DataFrame:
    arn = F.expr(KEY)
    return _nodes(read_table(s, d, "part"), "aws", F.concat(F.lit("aws|1|aws:kms:key|"), arn), "EncryptionKey", F.lit("1"), arn)


def people(s, d) -> DataFrame:
    return roles(s, d).select(F.col("arn").alias("principal"), F.col("node_id").alias("p_node"), "provider")


def doc(df: DataFrame, kind: str, source: str, document: str, account: str = "'000000000001'", target: str = "''", hint: str = "''") -> DataFrame:
    """Facts of a kind, with a policy document by a Spark SQL expression."""
    return _facts(df, kind, "aws", F.expr(source), F.expr(target), F.to_json(F.struct(F.expr(document).alias("document"))), account).withColumn("edge_hint", F.expr(hint))


def inline(s, d) -> DataFrame:
    """Two statements of each supplier: it reads the secret of its number, surely or from some address; every fifth is denied all."""
    return doc(read_table(s, d, "supplier"), "identity_policy", ROLE, """concat('{"Statement":[{"Sid":"one","Effect":"Allow","Action":["secretsmanager:GetSecretValue","kms:Decrypt"],"Resource":["arn:aws:secretsmanager:eu:000000000001:secret:p', s_suppkey, '","arn:aws:kms:eu:000000000001:key/p', s_suppkey, '"]',
      CASE WHEN s_suppkey % 3 = 0 THEN ',"Condition":{"IpAddress":{"aws:SourceIp":"10.0.0.0/8"}}' ELSE '' END, '},{"Sid":"two","Effect":"', CASE WHEN s_suppkey % 5 = 0 THEN 'Deny' ELSE 'Allow' END, '","NotAction":"iam:*","Resource":"', CASE WHEN s_suppkey % 5 = 0 THEN '*' ELSE 'none' END, '"}]}')""")


_R = "'arn:aws:iam::00000000000' || (s_suppkey % 2 + 1) || ':role/r' || s_suppkey"
_P = "'arn:aws:secretsmanager:eu:000000000001:secret:p' || s_suppkey"

query("parse_policy_statements", f"SELECT {_R} AS source, 'one' AS sid, 'Allow' AS effect, 2 AS actions, 0 AS not_actions, s_suppkey % 3 = 0 AS conditional FROM supplier UNION ALL SELECT {_R}, 'two', CASE s_suppkey % 5 WHEN 0 THEN 'Deny' ELSE 'Allow' END, 0, 1, false FROM supplier")(
    lambda s, d: P.parse_policy_statements(inline(s, d)).select("source", "sid", "effect", F.size("actions").alias("actions"), F.size("not_actions").alias("not_actions"), (F.size("conditions") > 0).alias("conditional"))
)


@query("principal_statements", f"SELECT {_R} AS principal, CASE x WHEN 'one' THEN 'identity_policy' WHEN 'two' THEN 'identity_policy' ELSE 'managed_policy' END AS kind, count(*) AS n FROM supplier, (VALUES ('one'), ('two'), ('own'), ('group')) AS v(x) WHERE x <> 'group' OR s_suppkey % 2 = 0 GROUP BY ALL UNION ALL SELECT 'group' || n_nationkey, 'managed_policy', 1 FROM nation")
def _statements(s, d):
    """Inline statements, a managed policy of the nation, and for every second supplier that of the nation's group."""
    supplier, nation = read_table(s, d, "supplier"), read_table(s, d, "nation")
    allow = """concat('{"Statement":{"Effect":"Allow","Action":"s3:GetObject","Resource":"', n_nationkey, '"}}')"""
    none = "'{}'"
    facts = (
        inline(s, d).unionByName(doc(nation, "managed_policy", "concat('policy', n_nationkey)", allow)).unionByName(doc(nation, "managed_policy", "concat('grouppolicy', n_nationkey)", allow))
        .unionByName(doc(supplier, "membership", ROLE, none, target="concat('policy', s_nationkey)", hint="'HasPolicy'"))
        .unionByName(doc(nation, "membership", "concat('group', n_nationkey)", none, target="concat('grouppolicy', n_nationkey)", hint="'HasPolicy'"))
        .unionByName(doc(supplier.where("s_suppkey % 2 = 0"), "membership", ROLE, none, target="concat('group', s_nationkey)", hint="'MemberOf'"))
    )
    return W.principal_statements(W.load_policies(facts)).groupBy("principal", "kind").agg(F.count("*").alias("n"))


def patterns(s, d) -> DataFrame:
    return read_table(s, d, "part").select("p_partkey", "p_brand", "p_type", F.expr("CASE WHEN p_partkey % 3 = 0 THEN array() ELSE array(concat('svc:', p_type)) END AS actions"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN array('svc:E*') ELSE array() END AS not_actions"), F.expr("CASE WHEN p_partkey % 4 < 2 THEN array() ELSE array(concat(p_brand, '/*'), 'x?z') END AS resources"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN array('Brand#1*') ELSE array() END AS not_resources"))


query("statement_action_match", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NOT upper(p_type) LIKE 'E%' ELSE true END AS own, CASE p_partkey % 3 WHEN 0 THEN false ELSE p_type = 'ECONOMY' END AS economy FROM part")(
    lambda s, d: patterns(s, d).select("p_partkey", P.statement_action_match(F.concat(F.lit("SVC:"), F.col("p_type"))).alias("own"), P.statement_action_match(F.lit("svc:economy")).alias("economy"))
)
query("statement_resource_match", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NOT p_brand LIKE 'Brand#1%' ELSE true END AS own, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE true END AS mark FROM part")(
    lambda s, d: patterns(s, d).select("p_partkey", P.statement_resource_match(F.concat("p_brand", F.lit("/k"))).alias("own"), P.statement_resource_match(F.lit("xyz")).alias("mark"))
)


def named(s, d) -> DataFrame:
    """Principals of five kinds beside each supplier: everyone, itself, its account's root, a pattern, somebody else."""
    kinds = F.expr(f"CASE s_suppkey % 5 WHEN 1 THEN array({ROLE}) WHEN 2 THEN array(concat('arn:aws:iam::00000000000', s_suppkey % 2 + 1, ':root')) WHEN 3 THEN array('arn:aws:iam::*:role/r*') WHEN 4 THEN array('arn:aws:iam::999999999999:root') ELSE array() END")
    return read_table(s, d, "supplier").select("s_suppkey", F.expr(ROLE).alias("p"), F.expr("s_suppkey % 5 = 0").alias("public"), kinds.alias("principals"))


query("principal_match_broad", "SELECT s_suppkey, s_suppkey % 5 < 4 AS hit FROM supplier")(lambda s, d: named(s, d).select("s_suppkey", P.principal_match_broad("p").alias("hit")))
query("principal_match_direct", "SELECT s_suppkey, s_suppkey % 5 IN (0, 1, 3) AS hit FROM supplier")(lambda s, d: named(s, d).select("s_suppkey", P.principal_match_direct("p").alias("hit")))
query("principal_names_root", "SELECT s_suppkey, s_suppkey % 5 = 2 AS hit FROM supplier")(lambda s, d: named(s, d).select("s_suppkey", P.principal_names_root(W.account_of("p")).alias("hit")))
query("principal_context", f"SELECT s_suppkey, '00000000000' || (s_suppkey % 2 + 1) AS account, {_R} AS arn FROM supplier")(lambda s, d: named(s, d).select("s_suppkey", P.principal_context("p").alias("k")).select("s_suppkey", F.expr("k['aws:principalaccount'][0]").alias("account"), F.expr("k['aws:principalarn'][0]").alias("arn")))


#: Twelve clauses: operator, key and values.
CLAUSES = (
    ("NumericLessThan", "quantity", ["25"]), ("NumericEquals", "quantity", ["10", "20"]), ("StringEquals", "flag", ["N"]), ("StringNotEquals", "flag", ["N"]), ("StringLike", "flag", ["?", "x"]), ("ForAllValues:StringEquals", "flag", ["N", "O"]),
    ("ForAnyValue:StringEquals", "flag", ["N", "O"]), ("DateGreaterThan", "shipped", ["1998-01-01T00:00:00Z"]), ("IpAddress", "ip", ["10.0.0.0/17"]), ("NotIpAddress", "ip", ["10.0.0.0/17"]), ("StringEqualsIfExists", "missing", ["x"]), ("Null", "aws:SourceIp", ["true"]),
)


def asked(s, d) -> DataFrame:
    """Line items as requests: what is known of them, and one of the twelve clauses."""
    known = F.expr("map('quantity', array(cast(l_quantity as string)), 'flag', array(l_returnflag, l_linestatus), 'shipped', array(concat(date_format(l_shipdate, 'yyyy-MM-dd'), 'T00:00:00Z')), 'ip', array(concat('10.0.', l_suppkey % 256, '.1')))")
    clauses = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(key).alias("key"), F.array(*map(F.lit, values)).alias("wanted")) for op, key, values in CLAUSES])
    numbered = read_table(s, d, "lineitem").withColumn("k", F.expr("cast((l_orderkey + l_linenumber) % 12 as int)"))
    return numbered.withColumn("known", known).withColumn("clause", F.get(clauses, F.col("k"))).select("l_orderkey", "l_linenumber", "l_partkey", "k", "known", "clause.op", "clause.key", "clause.wanted")


_CLAUSE = """CASE k WHEN 0 THEN if(l_quantity < 25, 0, 2) WHEN 1 THEN if(l_quantity IN (10, 20), 0, 2) WHEN 2 THEN if(l_returnflag = 'N' OR l_linestatus = 'N', 0, 2) WHEN 3 THEN if(l_returnflag <> 'N' OR l_linestatus <> 'N', 0, 2) WHEN 4 THEN 0
  WHEN 5 THEN if(l_returnflag IN ('N', 'O') AND l_linestatus IN ('N', 'O'), 0, 2) WHEN 6 THEN if(l_returnflag IN ('N', 'O') OR l_linestatus IN ('N', 'O'), 0, 2) WHEN 7 THEN if(l_shipdate::DATE > DATE '1998-01-01', 0, 2) WHEN 8 THEN if(l_suppkey % 256 < 128, 0, 2) WHEN 9 THEN if(l_suppkey % 256 < 128, 2, 0) WHEN 10 THEN 0 ELSE 1 END"""
_LINES = "(SELECT *, (l_orderkey + l_linenumber) % 12 AS k FROM lineitem)"
query("eval_clause", f"SELECT l_orderkey, l_linenumber, l_partkey, {_CLAUSE} AS outcome FROM {_LINES}")(
    lambda s, d: asked(s, d).select("l_orderkey", "l_linenumber", "l_partkey", P.eval_clause("op", "key", "wanted", "known").alias("outcome"))
)


def every_clause(s, d, kinds: tuple[int, ...]) -> DataFrame:
    """Each line item under every clause of some kinds: the outcomes one after the other."""
    outcomes = [P.eval_clause(F.lit(op), F.lit(key), F.array(*map(F.lit, values)), F.col("known")).cast("string") for op, key, values in (CLAUSES[k] for k in kinds)]
    return asked(s, d).select("l_orderkey", "l_linenumber", "l_partkey", F.concat(*outcomes).alias("outcomes"))


for _name, _some in (("condition_comparators", (0, 1, 2, 3, 4, 7, 8, 9)), ("condition_set_quantifiers", (5, 6))):
    _said = " || ".join(f"({_CLAUSE.replace('CASE k', f'CASE {k}')})" for k in _some)
    query(_name, f"SELECT l_orderkey, l_linenumber, l_partkey, {_said} AS outcomes FROM {_LINES} WHERE true")(lambda s, d, some=_some: every_clause(s, d, some))


@query("eval_conditions", f"SELECT l_orderkey, l_linenumber, l_partkey, greatest({_CLAUSE}, CASE l_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) AS outcome FROM {_LINES}")
def _conditions(s, d):
    """The clause, and another one that is unresolved, false or true: the worst counts."""
    second = F.expr("CASE l_partkey % 3 WHEN 0 THEN named_struct('op', 'Bool', 'key', 'aws:SecureTransport', 'values', array('true')) WHEN 1 THEN named_struct('op', 'StringEquals', 'key', 'absent', 'values', array('x')) ELSE named_struct('op', 'StringNotEquals', 'key', 'flag', 'values', array('x')) END")
    both = F.array(F.struct("op", "key", F.col("wanted").alias("values")), second)
    return asked(s, d).select("l_orderkey", "l_linenumber", "l_partkey", P.eval_conditions(both, "known").alias("outcome"))


query("candidate_pairs", "SELECT 'secretsmanager:GetSecretValue' AS action, 'arn:aws:secretsmanager:eu:000000000001:secret:p' || p_partkey AS target_arn FROM part UNION ALL SELECT a, 'arn:aws:kms:eu:000000000001:key/p' || p_partkey FROM part, (VALUES ('kms:Decrypt'), ('kms:PutKeyPolicy')) AS v(a)")(
    lambda s, d: W.candidate_resources(secrets(s, d).unionByName(keys(s, d))).select("action", "target_arn")
)


def identity(s, d, nodes: DataFrame) -> DataFrame:
    return W._identity_allows(W.load_policies(inline(s, d)), stored(W.candidate_resources(nodes), "resources"), people(s, d))


query("allowed_by", f"SELECT {_R} AS principal, {_P} AS target_arn, s_suppkey % 3 <> 0 AS solid, CASE s_suppkey % 3 WHEN 0 THEN 'IpAddress:aws:SourceIp' ELSE '' END AS labels FROM supplier JOIN part ON p_partkey = s_suppkey")(
    lambda s, d: identity(s, d, secrets(s, d)).where("action = 'secretsmanager:GetSecretValue'").select("principal", "target_arn", "solid", F.array_join("labels", ",").alias("labels"))
)
query("explicit_deny", f"SELECT {_R} AS principal, {_P} AS target_arn, true AS hard FROM supplier JOIN part ON p_partkey = s_suppkey WHERE s_suppkey % 5 = 0")(
    lambda s, d: W.explicit_deny(stored(identity(s, d, secrets(s, d)), "pairs"), W.load_policies(inline(s, d))).select("principal", "target_arn", "hard")
)


@query("scp_gate", f"SELECT {_R} AS principal FROM supplier JOIN part ON p_partkey = s_suppkey WHERE s_suppkey % 2 = 0")
def _scp(s, d):
    """Account 2 (odd suppliers) has a policy that allows only storage; account 1 has one that allows secrets."""
    scp = doc(read_table(s, d, "region").where("r_regionkey < 2"), "scp", "concat('scp', r_regionkey)", """concat('{"Statement":{"Effect":"Allow","Action":"', CASE r_regionkey WHEN 0 THEN 'secretsmanager:*' ELSE 's3:*' END, '","Resource":"*"}}')""", account="concat('00000000000', cast(r_regionkey + 1 as string))")
    return W.scp_gate(stored(identity(s, d, secrets(s, d)), "pairs"), W.load_policies(scp)).select("principal")


@query("boundary_gate", f"SELECT {_R} AS principal FROM supplier JOIN part ON p_partkey = s_suppkey WHERE s_suppkey % 3 <> 1")
def _boundary(s, d):
    """Every third supplier has no boundary, the next one a boundary without secrets, the last one with."""
    bound = doc(read_table(s, d, "supplier").where("s_suppkey % 3 > 0"), "permission_boundary", ROLE, """concat('{"Statement":{"Effect":"Allow","Action":"', CASE s_suppkey % 3 WHEN 1 THEN 's3:*' ELSE 'secretsmanager:*' END, '","Resource":"*"}}')""")
    return W.boundary_gate(stored(identity(s, d, secrets(s, d)), "pairs"), W.load_policies(bound)).select("principal")


@query("combine_decision", f"""WITH i AS (SELECT {_R} AS principal, {_P} AS t, s_suppkey FROM supplier JOIN part ON p_partkey = s_suppkey), r AS (SELECT {_R} AS principal, {_P} AS t FROM supplier JOIN part ON p_partkey = s_suppkey WHERE s_suppkey % 4 < 2)
SELECT i.principal, i.t AS target_arn, CASE WHEN r.t IS NOT NULL THEN 'identity+resource' ELSE 'identity' END AS via, s_suppkey % 3 = 0 AS conditional FROM i LEFT JOIN r ON i.t = r.t WHERE r.t IS NOT NULL OR s_suppkey % 2 = 0""")
def _combined(s, d):
    """Suppliers of account 2 need the secret's own policy as well; half of the secrets have one."""
    grants = doc(read_table(s, d, "supplier").where("s_suppkey % 4 < 2"), "resource_policy", "concat('arn:aws:secretsmanager:eu:000000000001:secret:p', s_suppkey)", f"""concat('{{"Statement":{{"Effect":"Allow","Action":"secretsmanager:GetSecretValue","Principal":{{"AWS":"', {ROLE}, '"}}}}}}')""")
    resources = stored(W.candidate_resources(secrets(s, d)), "resources")
    mine = W._identity_allows(W.load_policies(inline(s, d)), resources, people(s, d))
    theirs = W._resource_allows(W.load_policies(grants), resources, people(s, d))
    return W.combine_decision(mine, theirs).select("principal", "target_arn", "via", "conditional")


@query("kms_decision", f"""WITH i AS (SELECT {_R} AS principal, s_suppkey AS k FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT principal, 'arn:aws:kms:eu:000000000001:key/p' || k AS target_arn, CASE k % 4 WHEN 0 THEN 'resource' ELSE 'identity' END AS via, CASE k % 4 WHEN 0 THEN false WHEN 1 THEN k % 3 = 0 ELSE true END AS conditional FROM i WHERE k % 4 <> 2""")
def _kms(s, d):
    """Keys whose policy names the supplier, the root of its account, somebody else, or that nobody has collected."""
    grants = doc(read_table(s, d, "supplier").where("s_suppkey % 4 < 3"), "resource_policy", "concat('arn:aws:kms:eu:000000000001:key/p', s_suppkey)", f"""concat('{{"Statement":{{"Effect":"Allow","Action":"kms:Decrypt","Principal":{{"AWS":"', CASE s_suppkey % 4 WHEN 0 THEN {ROLE} WHEN 1 THEN concat('arn:aws:iam::00000000000', s_suppkey % 2 + 1, ':root') ELSE 'arn:aws:iam::999999999999:role/none' END, '"}}}}}}')""")
    resources = stored(W.candidate_resources(keys(s, d)), "resources")
    mine = stored(W._identity_allows(W.load_policies(inline(s, d)), resources, people(s, d)).where("action = 'kms:Decrypt'"), "identity")
    found = W.kms_decision(mine, W.load_policies(grants), resources, people(s, d)).where("action = 'kms:Decrypt'")
    own = found.where(F.substring_index("principal", "/r", -1) == F.substring_index("target_arn", "/p", -1))
    return own.select("principal", "target_arn", "via", "conditional")


# Binding model: customers hold roles on their nation's project and on buckets of suppliers


def bindings(s, d) -> DataFrame:
    """A storage role on the project (every third under a condition), another role on one bucket, an agent of the provider, and roles that nobody knows."""
    customer = read_table(s, d, "customer")
    user, nation = F.expr("concat('user:c', c_custkey, '@x.org')"), F.expr("concat('n', c_nationkey)")
    bag = lambda role, level, condition="''": F.to_json(F.struct(F.expr(role).alias("role"), F.lit(level).alias("level"), F.expr(condition).alias("condition")))
    account = "concat('n', cast(c_nationkey as string))"
    return (
        _facts(customer, "iam_binding", "gcp", user, nation, bag("'roles/store'", "project", "CASE c_custkey % 3 WHEN 0 THEN 'expr' ELSE '' END"), account)
        .unionByName(_facts(customer, "iam_binding", "gcp", user, F.expr("concat('//b', c_custkey)"), bag("CASE c_custkey % 2 WHEN 0 THEN 'roles/store' ELSE 'roles/lost' END", "bucket"), account))
        .unionByName(_facts(customer, "iam_binding", "gcp", F.expr("concat('serviceAccount:service-', c_custkey, '@gcp-sa-x.iam.gserviceaccount.com')"), nation, bag("'roles/store'", "project"), account))
        .unionByName(_facts(read_table(s, d, "region").where("r_regionkey = 0"), "role_permissions", "gcp", F.lit("roles/store"), F.lit(""), F.lit('{"permissions":["storage.objects.get","storage.objects.create"]}')))
    )


def buckets(s, d) -> DataFrame:
    account = F.expr("concat('n', s_nationkey)")
    return _nodes(read_table(s, d, "supplier"), "gcp", F.concat_ws("|", F.lit("gcp"), account, F.lit("gcp:storage:bucket"), F.expr("concat('b', s_suppkey)")), "ObjectStorage", account, F.expr("concat('//b', s_suppkey)"))


_BUCKET = "'gcp|n' || s_nationkey || '|gcp:storage:bucket|b' || s_suppkey"
query("binding_grants", """SELECT 'user:c' || c_custkey || '@x.org' AS member, 'n' || c_nationkey AS held, c_custkey % 3 = 0 AS conditional, 2 AS permissions FROM customer UNION ALL SELECT 'user:c' || c_custkey || '@x.org', '//b' || c_custkey, false, 2 FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'serviceAccount:service-' || c_custkey || '@gcp-sa-x.iam.gserviceaccount.com', 'n' || c_nationkey, false, 2 FROM customer""")(
    lambda s, d: G.binding_grants(bindings(s, d)).select("member", F.coalesce("project", "target").alias("held"), "conditional", F.size("permissions").alias("permissions"))
)
query("conditional_flag", "SELECT o_custkey, min(o_orderkey % 3) > 0 AS conditional FROM orders GROUP BY o_custkey")(lambda s, d: read_table(s, d, "orders").groupBy("o_custkey").agg(G.conditional_flag(F.col("o_orderkey") % 3 > 0).alias("conditional")))
query("exclude_provider_agents", "SELECT 'user:c' || c_custkey || '@x.org' AS member, count(*) AS n FROM customer, (VALUES (0), (1)) AS v(k) WHERE k = 0 OR c_custkey % 2 = 0 GROUP BY c_custkey")(lambda s, d: G.exclude_provider_agents(G.binding_grants(bindings(s, d))).groupBy("member").agg(F.count("*").alias("n")))
query("resource_name_index", f"SELECT n AS name, {_BUCKET} AS node_id FROM supplier, (VALUES ('//b'), ('b')) AS v(p), LATERAL (SELECT p || s_suppkey AS n)")(lambda s, d: G.resource_name_index(buckets(s, d)))


def members(s, d) -> DataFrame:
    return read_table(s, d, "customer").select(F.expr("CASE c_custkey % 5 WHEN 0 THEN concat('user:c', c_custkey, '@x.org') WHEN 1 THEN concat('group:g', c_custkey, '@y.org') WHEN 2 THEN concat('deleted:user:', c_custkey) WHEN 3 THEN concat('serviceAccount:b', c_custkey) ELSE concat('odd:', c_custkey) END").alias("member"))


@query("resolve_members", """SELECT 'user:c' || c_custkey || '@x.org' AS member, 'gcp|x.org|gcp:iam:user|c' || c_custkey || '@x.org' AS source FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'group:g' || c_custkey || '@y.org', 'gcp|y.org|gcp:iam:group|g' || c_custkey || '@y.org' FROM customer WHERE c_custkey % 5 = 1
UNION ALL SELECT 'serviceAccount:b' || c_custkey, CASE WHEN s_suppkey IS NULL THEN 'gcp|external|gcp:iam:service-account|b' || c_custkey ELSE 'gcp|n' || s_nationkey || '|gcp:storage:bucket|b' || s_suppkey END FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey % 5 = 3""")
def _members(s, d):
    """Users, groups and service accounts, which some supplier's node may be; deleted and unknown kinds have no node."""
    return G.resolve_members(members(s, d), buckets(s, d).withColumn("node_type", F.lit("ServiceAccount")))[0]


def held(s, d) -> DataFrame:
    grants = stored(G.exclude_provider_agents(G.binding_grants(bindings(s, d))), "grants")
    return stored(G._held(grants.withColumn("source", F.col("member")), G.capabilities(s)), "held")


query("project_wide_edges", f"SELECT e AS edge, 'user:c' || c_custkey || '@x.org' AS source, {_BUCKET} AS target, c_custkey % 3 = 0 AS conditional FROM customer JOIN supplier ON s_nationkey = c_nationkey, (VALUES ('CanReadData'), ('CanWriteData')) AS v(e)")(
    lambda s, d: G.project_wide_edges(held(s, d), buckets(s, d)).select("edge", "source", "target", "conditional")
)
query("resource_scoped_edges", f"SELECT e AS edge, 'user:c' || c_custkey || '@x.org' AS source, {_BUCKET} AS target FROM customer JOIN supplier ON s_suppkey = c_custkey, (VALUES ('CanReadData'), ('CanWriteData')) AS v(e) WHERE c_custkey % 2 = 0")(
    lambda s, d: G.resource_scoped_edges(held(s, d), buckets(s, d)).select("edge", "source", "target")
)
query("dedup_upgrade", "SELECT 'c' || o_custkey AS source, o_orderpriority AS target, CASE WHEN min(o_orderkey % 3) > 0 THEN 'CONDITIONAL' ELSE 'ACTIVE' END AS state, 'f' || min(o_orderkey) AS fact FROM orders GROUP BY ALL")(
    lambda s, d: dedup_upgrade(read_table(s, d, "orders").select(F.lit("CanReadData").alias("edge"), F.concat(F.lit("c"), s_("o_custkey")).alias("source"), F.col("o_orderpriority").alias("target"), F.lit("").alias("scope"), F.lit("CREDENTIAL").alias("kind"), F.lit(1.0).alias("weight"), F.lit("get").alias("permission"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3 > 0).alias("conditional"), F.array(F.concat(F.lit("f"), s_("o_orderkey"))).alias("facts")), "x", "y").select("source", "target", "state", F.col("facts")[0].alias("fact"))
)
query("foothold_node", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'gcp|p1|gcp:iam:service-account|a@p1.iam.gserviceaccount.com' WHEN 1 THEN 'gcp|x.org|gcp:iam:user|c' || c_custkey || '@x.org' END AS node_id FROM customer")(
    lambda s, d: read_table(s, d, "customer").select("c_custkey", G.foothold_node(F.expr("CASE c_custkey % 3 WHEN 0 THEN 'a@p1.iam.gserviceaccount.com' WHEN 1 THEN concat('c', c_custkey, '@x.org') ELSE c_name END"))["node_id"].alias("node_id"))
)

# Scoped-role model: customers and their nation's group hold roles on subscriptions (nations), whose vaults are suppliers


def az(df: DataFrame, kind: str, source: str, target: str = "''", attributes: str = "'{}'") -> DataFrame:
    return _facts(df, kind, "azure", F.expr(source), F.expr(target), F.expr(attributes))


def directory(s, d) -> DataFrame:
    """Groups of nations with customers as members; every second customer is told by the directory."""
    customer = read_table(s, d, "customer")
    return az(customer, "member_of", "concat('c', c_custkey)", "concat('g', c_nationkey)").unionByName(az(customer.where("c_custkey % 2 = 0"), "principal", "concat('c', c_custkey)", "''", """to_json(named_struct('displayName', c_name, 'type', 'User'))"""))


def vaults(s, d) -> DataFrame:
    sub, arn = F.expr("concat('n', s_nationkey)"), F.expr("concat('/subscriptions/n', s_nationkey, '/resourceGroups/g', s_suppkey % 3, '/vault/v', s_suppkey)")
    return _nodes(read_table(s, d, "supplier"), "azure", F.concat_ws("|", F.lit("azure"), sub, F.lit("azure:keyvault:vault"), arn), "Secret", sub, arn)


READER = """'{"actions":[],"notActions":[],"dataActions":["Microsoft.KeyVault/vaults/secrets/getSecret/action"],"notDataActions":[]}'"""


def reader(s, d) -> DataFrame:
    return az(read_table(s, d, "region").where("r_regionkey = 0"), "role_definition", "'/x/reader'", "''", READER)


def assigned(s, d) -> DataFrame:
    """Every nation's group reads the nation's subscription, under a condition for every second nation."""
    return az(read_table(s, d, "nation"), "role_assignment", "concat('g', n_nationkey)", "concat('/subscriptions/n', n_nationkey)", """to_json(named_struct('roleDefinitionId', '/y/Reader', 'condition', CASE n_nationkey % 2 WHEN 0 THEN 'c' ELSE '' END))""")


query("expand_group_assignments", "SELECT 'g' || n_nationkey AS principal, '/subscriptions/n' || n_nationkey AS scope, n_nationkey % 2 = 0 AS conditional FROM nation UNION ALL SELECT 'c' || c_custkey, '/subscriptions/n' || c_nationkey, c_nationkey % 2 = 0 FROM customer JOIN nation ON c_nationkey = n_nationkey")(
    lambda s, d: A.expand_group_assignments(A.assignments(assigned(s, d)), directory(s, d)).select("principal", "scope", "conditional")
)
query("resolve_principals", "SELECT 'c' || c_custkey AS principal, 'azure|entra|azure:entra:' || CASE c_custkey % 2 WHEN 0 THEN 'user' ELSE 'serviceprincipal' END || '|c' || c_custkey AS source FROM customer")(
    lambda s, d: A.resolve_principals(read_table(s, d, "customer").select(F.expr("concat('c', c_custkey)").alias("principal")), directory(s, d), vaults(s, d))[0]
)
query("container_nodes", """SELECT DISTINCT 'Subscription' AS node_type, '/subscriptions/n' || s_nationkey AS arn FROM supplier UNION ALL SELECT DISTINCT 'ResourceGroup', '/subscriptions/n' || s_nationkey || '/resourceGroups/g' || s_suppkey % 3 FROM supplier
UNION ALL SELECT 'ManagementGroup', '/providers/Microsoft.Management/managementGroups/r' || r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")(
    lambda s, d: A.container_nodes(az(read_table(s, d, "nation"), "mg_hierarchy", "concat('r', n_regionkey)", "concat('n', n_nationkey)", """'{"childType":"subscription"}'"""), vaults(s, d)).select("node_type", "arn")
)


@query("role_action_match", "SELECT 'role' || p_partkey AS role, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 0 END AS reads FROM part WHERE p_partkey % 2 = 0")
def _roles(s, d):
    """Roles that name the action, that exclude it, that have a wildcard, and that have nothing."""
    body = """CASE p_partkey % 4 WHEN 0 THEN '{"dataActions":["Microsoft.KeyVault/vaults/secrets/getSecret/action"]}' WHEN 1 THEN '{"dataActions":["*"],"notDataActions":["Microsoft.KeyVault/*"]}' WHEN 2 THEN '{"dataActions":["Microsoft.KeyVault/vaults/secrets/*"]}' ELSE '{}' END"""
    secret = [k for k, c in enumerate(A.AZURE_CAPABILITIES) if c[0] == "CanReadSecret" and c[1].endswith("getSecret/action")]
    found = A.role_action_match(az(read_table(s, d, "part"), "role_definition", "concat('/x/ROLE', p_partkey)", "''", body)).where(F.col("ord").isin(*secret))
    return found.select("role", F.lit(1).alias("reads"))


query("deny_assignments", """SELECT 'g' || n_nationkey AS principal, s_suppkey AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 3 = 0""")(
    lambda s, d: A.deny_assignments(az(read_table(s, d, "nation").where("n_nationkey % 3 = 0"), "deny_assignment", "concat('g', n_nationkey)", "concat('/subscriptions/N', n_nationkey)", """'{"actions":["*"],"notActions":[]}'"""), vaults(s, d)).select("principal", F.regexp_extract("node_id", "/v([0-9]+)$", 1).cast("long").alias("k")).distinct()
)


@query("rbac_edges", """SELECT 'p' || p AS source, s_suppkey AS k, CASE n_nationkey % 2 WHEN 0 THEN 'CONDITIONAL' ELSE 'ACTIVE' END AS state FROM nation JOIN supplier ON s_nationkey = n_nationkey, LATERAL (SELECT 'g' || n_nationkey AS p UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_nationkey = n_nationkey)
WHERE NOT (n_nationkey % 3 = 0 AND p LIKE 'g%')""")
def _rbac(s, d):
    """Groups and members read their subscription's vaults, but for groups that a deny assignment names."""
    deny = az(read_table(s, d, "nation").where("n_nationkey % 3 = 0"), "deny_assignment", "concat('g', n_nationkey)", "concat('/subscriptions/n', n_nationkey)", """'{"actions":["*"],"notActions":[]}'""")
    facts = stored(assigned(s, d).unionByName(directory(s, d)).unionByName(reader(s, d)).unionByName(deny), "facts")
    ids = facts.where("kind in ('role_assignment', 'member_of')").select(F.col("source").alias("principal")).distinct()
    nothing = s.createDataFrame([], "mg string, subscription string")
    edges = A.rbac_edges(facts, vaults(s, d), nothing, ids.withColumn("source", F.concat(F.lit("p"), "principal")))
    return edges.where("type = 'CanReadSecret'").select("source", F.substring_index("target", "/v", -1).try_cast("long").alias("k"), "state")


@query("container_takeover", """SELECT 'g' AS source, 'azure|n' || n_nationkey || '|azure:resourcemanager:subscription|/subscriptions/n' || n_nationkey AS target FROM nation WHERE n_regionkey = 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'h', 'azure|n' || s_nationkey || '|azure:keyvault:vault|/subscriptions/n' || s_nationkey || '/resourceGroups/g' || s_suppkey % 3 || '/vault/v' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 1""")
def _containers(s, d):
    """One may grant on the group of region 0, another on all resource groups of one name."""
    tree = az(read_table(s, d, "nation"), "mg_hierarchy", "concat('r', n_regionkey)", "concat('n', n_nationkey)", """'{"childType":"subscription"}'""")
    nodes = stored(A.container_nodes(tree, vaults(s, d)).unionByName(vaults(s, d)), "nodes")
    over = nodes.where("node_type = 'ManagementGroup' and arn like '%/r0'").select(F.lit("g").alias("source"), F.col("node_id").alias("target")).unionByName(nodes.where("node_type = 'ResourceGroup' and arn like '%/g1'").select(F.lit("h"), "node_id").toDF("source", "target"))
    return A.container_takeover(over.withColumn("type", F.lit("CanGrantPermission")), nodes, A.mg_closure(tree)).select("source", "target")


def _holders(s, d, kind: str, key: str, template: str) -> tuple[DataFrame, DataFrame]:
    """Every nation's group holds a directory role; customers are its members, and have nodes of their own."""
    facts = az(read_table(s, d, "nation"), kind, "concat('g', n_nationkey)", "''", f"""'{{"{key}":"{template.upper()}"}}'""").unionByName(directory(s, d))
    ids = facts.where("kind != 'principal'").select(F.col("source").alias("principal")).distinct()
    return facts, ids.withColumn("source", F.concat(F.lit("p"), "principal"))


_HOLDERS = "(SELECT 'g' || n_nationkey AS p FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation))"


@query("directory_role_edges", f"SELECT 'CanResetCredential' AS type, 'p' || p AS source, 'user' || r_regionkey AS target FROM {_HOLDERS}, region")
def _directory(s, d):
    """Helpdesk groups over people, who are regions here."""
    template = next(r[0] for r in A.DIRECTORY_ROLES if r[1] == "CanResetCredential")
    facts, principals = _holders(s, d, "entra_role_assignment", "roleTemplateId", template)
    users = _nodes(read_table(s, d, "region"), "azure", F.expr("concat('user', r_regionkey)"), "HumanIdentity", F.lit("entra"), F.expr("concat('u', r_regionkey)"))
    return A.directory_role_edges(facts, users, principals).select("type", "source", "target")


@query("app_role_edges", f"SELECT 'p' || p AS source, 'node' || r_regionkey AS target FROM {_HOLDERS}, region")
def _app(s, d):
    template, _, reaches, _ = A.APP_ROLES[0]
    facts, principals = _holders(s, d, "entra_app_role", "appRoleId", template)
    nodes = _nodes(read_table(s, d, "region"), "azure", F.expr("concat('node', r_regionkey)"), reaches, F.lit("entra"), F.expr("concat('u', r_regionkey)"))
    return A.app_role_edges(facts, nodes, principals).select("source", "target")


query("expand_group_holders", "SELECT 'g' || n_nationkey AS principal, n_nationkey AS k FROM nation UNION ALL SELECT 'c' || c_custkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'boss' || n_regionkey, n_nationkey FROM nation")(
    lambda s, d: A.expand_group_holders(read_table(s, d, "nation").select(F.expr("concat('g', n_nationkey)").alias("principal"), F.col("n_nationkey").alias("k")), directory(s, d).unionByName(az(read_table(s, d, "nation"), "entra_group_owner", "concat('boss', n_regionkey)", "concat('g', n_nationkey)"))).select("principal", "k")
)


@query("owner_edges", "SELECT 'CanCreateCredentialFor' AS type, 'po' || s_suppkey AS source, 'psp' || s_suppkey AS target FROM supplier UNION ALL SELECT 'CanAddMember', 'pboss' || n_regionkey, 'pg' || n_nationkey FROM nation")
def _owners(s, d):
    facts = az(read_table(s, d, "supplier"), "entra_owner", "concat('o', s_suppkey)", "concat('sp', s_suppkey)").unionByName(az(read_table(s, d, "nation"), "entra_group_owner", "concat('boss', n_regionkey)", "concat('g', n_nationkey)"))
    principals = facts.select(F.explode(F.array("source", "target")).alias("principal")).distinct().withColumn("source", F.concat(F.lit("p"), "principal"))
    nodes = principals.select(F.col("source").alias("node_id"), F.lit("x").alias("arn"))
    return A.owner_edges(facts, principals, nodes).select("type", "source", "target")


@query("internet_exposures", "SELECT 'azure|' || p_partkey AS source, CASE p_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' END AS severity FROM part WHERE p_partkey % 5 < 4")
def _internet(s, d):
    """Parts as storage accounts: with a public container, open to all networks, permitted only, publicly reachable, closed."""
    bag = F.expr("""CASE p_partkey % 5 WHEN 0 THEN '{"properties":{"allowBlobPublicAccess":true}}' WHEN 1 THEN '{"properties":{"allowBlobPublicAccess":true,"networkAcls":{"defaultAction":"Allow"}}}' WHEN 2 THEN '{"properties":{"allowBlobPublicAccess":true,"networkAcls":{"defaultAction":"Deny"}}}' WHEN 3 THEN '{"properties":{"publicNetworkAccess":"Enabled"}}' ELSE '{"properties":{}}' END""")
    nodes = _nodes(read_table(s, d, "part"), "azure", F.expr("concat('azure|', p_partkey)"), "ObjectStorage", F.lit("n"), F.expr("concat('/a/', p_partkey)")).withColumn("k", F.expr("cast(substr(arn, 4) as long)"))
    filled = nodes.drop("attributes").join(read_table(s, d, "part").select(F.col("p_partkey").alias("k"), bag.alias("attributes")), "k")
    return A.internet_exposures(az(read_table(s, d, "part").where("p_partkey % 5 = 0"), "public_container", "concat('/A/', p_partkey)"), filled).select("source", F.get_json_object("evidence", "$.severity").alias("severity"))


# De-identification


def identifiers(s, d) -> DataFrame:
    """Customers as one of five kinds of identifiers."""
    real = F.expr("CASE c_custkey % 5 WHEN 0 THEN concat('c', c_custkey, '@corp.com') WHEN 1 THEN concat('h', c_custkey, '.prod.corp.com') WHEN 2 THEN lpad(cast(c_custkey as string), 12, '0') WHEN 3 THEN concat('10.', c_custkey % 256, '.', c_custkey % 7, '.9') ELSE c_name END")
    return read_table(s, d, "customer").select("c_custkey", real.alias("real")).withColumn("type", R.classify_identifier("real"))


_KINDS = "CASE c_custkey % 5 WHEN 0 THEN 'user_email' WHEN 1 THEN 'hostname' WHEN 2 THEN 'aws_account' WHEN 3 THEN 'ip' ELSE 'other' END"


@query("fake_for", f"SELECT c_custkey, {_KINDS} AS type, true AS fits, false AS same FROM customer")
def _fakes(s, d):
    """Fakes have the type of what they stand for, and differ from it."""
    own = stored(identifiers(s, d), "own")
    made = own.join(R.identifier_map(own.select("real", "type"), SALT).select("real", "fake"), "real")
    return made.select("c_custkey", "type", (R.classify_identifier("fake") == F.col("type")).alias("fits"), (F.col("fake") == F.col("real")).alias("same"))


@query("prefix_preserving_ip", "WITH a AS (SELECT c_custkey, c_custkey % 256 AS x, c_custkey % 7 AS y FROM customer WHERE c_custkey % 5 = 3) SELECT a.c_custkey AS a, b.c_custkey AS b, a.x = b.x AS share16, a.x = b.x AND a.y = b.y AS share24 FROM a JOIN a b ON b.c_custkey = a.c_custkey + 5")
def _addresses(s, d):
    """Neighbours share 16 or 24 bits of their fakes exactly where they share them themselves."""
    own = identifiers(s, d).where("type = 'ip'")
    made = stored(own.join(R.identifier_map(own.select("real", "type"), SALT).select("real", "fake"), "real"), "fakes")
    a, b = made.select(F.col("c_custkey").alias("a"), F.col("fake").alias("f")), made.select((F.col("c_custkey") - 5).alias("a"), F.col("c_custkey").alias("b"), F.col("fake").alias("g"))
    same = lambda n: F.substring_index("f", ".", n) == F.substring_index("g", ".", n)
    return a.join(b, "a").select("a", "b", same(2).alias("share16"), same(3).alias("share24"))


@query("transform_fields", f"WITH {GRAPH_SQL} SELECT node_type, count(*) AS n, count(DISTINCT node_id) AS ids, 0 AS kept FROM nodes GROUP BY node_type")
def _transformed(s, d):
    """Ids stay as distinct as they were, and none keeps its account or name."""
    nodes = stored(access_nodes(s, d).withColumn("attributes", F.to_json(F.struct(F.concat(F.lit("about "), "node_id").alias("note")))), "nodes")
    out = R.transform_fields(nodes, R.identifier_map(R.all_identifiers({"nodes": nodes}), SALT), SALT)
    kept = out.join(nodes.select("node_id"), "node_id", "left_semi")
    return out.groupBy("node_type").agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("ids")).withColumn("kept", F.lit(0)).unionByName(kept.groupBy("node_type").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("ids"), F.count("*").cast("int").alias("kept")))


@query("redact_tags", "SELECT c_custkey, 'owner,size' AS keys, true AS hidden, '7' AS size FROM customer")
def _tags(s, d):
    own = read_table(s, d, "customer").select("c_custkey", "c_name", F.expr("map('owner', c_name, 'size', '7')").alias("tags"))
    mapping = R.identifier_map(own.select(F.col("c_name").alias("real"), F.lit("opaque").alias("type")), SALT)
    return R.redact_tags(own, "tags", mapping).select("c_custkey", F.array_join(F.sort_array(F.map_keys("tags")), ",").alias("keys"), (F.col("tags")["owner"] != F.col("c_name")).alias("hidden"), F.col("tags")["size"].alias("size"))


_DAYS, _HOURS = R.time_offset(SALT)
query("shift_timestamps", f"SELECT o_orderkey, epoch(o_orderdate)::BIGINT - {_DAYS * 86400 + _HOURS * 3600} AS seconds FROM orders")(lambda s, d: read_table(s, d, "orders").select("o_orderkey", F.unix_timestamp(R.shift_timestamps(F.col("o_orderdate").cast("timestamp"), SALT)).alias("seconds")))
query("token_for", "SELECT count(*) AS n, count(DISTINCT c_name) AS tokens, 0 AS kept FROM customer")(
    lambda s, d: read_table(s, d, "customer").select("c_name", R.token_for(SALT, "ref", F.col("c_name")).alias("t")).agg(F.count("*").alias("n"), F.count_distinct("t").alias("tokens"), F.count_if((F.col("t") == F.col("c_name")) | ~F.col("t").startswith("ref-")).cast("int").alias("kept"))
)


def renamed(s, d) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The graph with customers' names, and an output in which every seventh kept it, inside a longer word."""
    nodes = stored(access_nodes(s, d).where("node_type = 'HumanIdentity'").withColumn("arn", F.concat(F.lit("person-"), F.substring_index("node_id", "|", -1))), "nodes")
    hidden = F.when(F.substring_index("arn", "-", -1).cast("long") % 7 != 0, F.lit("hidden")).otherwise(F.concat(F.lit("see_"), "arn", F.lit("x")))
    return {"nodes": nodes.select(F.col("arn").alias("name"), "node_type")}, {"nodes": nodes.select(hidden.alias("name"), "node_type")}


query("leak_audit", "SELECT DISTINCT 'nodes' AS file, 'person-' || a.c_custkey AS token FROM customer a JOIN customer b ON b.c_custkey % 7 = 0 AND contains('see_person-' || b.c_custkey || 'x', 'person-' || a.c_custkey)")(lambda s, d: R.leak_audit(*renamed(s, d)))


@query("isomorphism_check", f"WITH {GRAPH_SQL} SELECT 'count' AS problem, 'edges' AS key, count(*) AS n_before, count(*) FILTER (type <> 'CanReadData') AS n_after FROM edges UNION ALL SELECT 'edge_type', 'CanReadData', count(*), NULL FROM edges WHERE type = 'CanReadData'")
def _shape(s, d):
    """An output without the reading edges."""
    nodes, edges = access_nodes(s, d), stored(access_edges(s, d), "graph")
    return R.isomorphism_check({"nodes": nodes, "edges": edges}, {"nodes": nodes, "edges": edges.where("type != 'CanReadData'")}).select("problem", "key", "n_before", "n_after")


query("mapping_stats", "SELECT CASE c_custkey % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'host' ELSE 'id' END AS prefix, count(*) AS n FROM customer WHERE c_custkey % 5 IN (0, 1, 4) GROUP BY 1")(
    lambda s, d: R.mapping_stats(R.identifier_map(identifiers(s, d).select("real", "type"), SALT)).where("prefix != ''")
)
