"""Steps whose work once grew faster than their input: what meets what, by plans and counts of rows."""

import json

import pytest
from helpers import allow, doc, facts, nodes
from pyspark.sql import functions as F

from arcwarden import tables
from arcwarden.operators import aws, azure, gcp, grants
from arcwarden.sources import extract as X


@pytest.mark.parametrize("name, op, body", [
    ("extract_member_of", "transitiveMembers", {"group": "g", "value": [{"id": "a"}, {"id": "b"}, {"id": ""}]}),
    ("extract_public_containers", "containers", {"account": "g", "value": [{"name": "a", "properties": {"publicAccess": "Blob"}}, {"name": "b", "properties": {"publicAccess": "Blob"}}]}),
    ("extract_iam_bindings", "getIamPolicy", {"target": "g", "bindings": [{"role": "r", "members": ["a", "b"]}]}),
    ("extract_mg_hierarchy", "managementGroups", {"name": "g", "properties": {"children": [{"name": "a"}, {"name": "b"}]}}),
])
def test_responses_are_not_read_for_each_record(spark, name, op, body):
    raw = spark.createDataFrame([(op, json.dumps(body))], "op string, body string").select("op", F.lit("x").alias("scope"), "body")
    found = getattr(X, name)(raw)
    above, generate, _ = found._jdf.queryExecution().optimizedPlan().toString().partition("Generate explode")
    assert generate and "body#" not in above and found.count() == 2


def test_roots_meet_what_identity_policies_grant(spark):
    """A key whose policy names an account's root gives rows for the pairs that identity policies grant, not for all principals of the account."""
    key = "arn:aws:kms:eu:000000000001:key/k"
    people = spark.createDataFrame([(f"arn:aws:iam::000000000001:role/r{k}",) for k in range(50)], "principal string")
    grants = spark.createDataFrame([("f", "000000000001", ["arn:aws:iam::000000000001:root"], False, "kms:Decrypt", key)], "fact_id string, at string, principals array<string>, public boolean, action string, target_arn string")
    identity = people.limit(2).select("principal", F.lit("kms:Decrypt").alias("action"), F.lit(key).alias("target_arn"))
    rows = aws._key_principals(grants, people, identity).collect()
    assert len(rows) == 2 and all(r["root"] and not r["names"] for r in rows)


def test_policies_of_an_account_go_to_its_pairs(spark):
    """One account may have most of the pairs: they aren't dealt by account."""
    scp = ("scp", "", "s", "", {"document": doc(allow("secretsmanager:*", "*"))}, "aws", "000000000001")
    policies = aws.load_policies(facts(spark, scp))
    pairs = spark.createDataFrame([(f"arn:aws:iam::00000000000{a}:role/r", x, "t") for a in (1, 2) for x in ("secretsmanager:GetSecretValue", "kms:Decrypt")], "principal string, action string, target_arn string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gated = aws.scp_gate(pairs, policies)
        assert "SortMergeJoin" not in gated._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["principal"].split(":")[4][-1], r["action"]) for r in gated.collect()) == [("1", "secretsmanager:GetSecretValue"), ("2", "kms:Decrypt"), ("2", "secretsmanager:GetSecretValue")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_written_out_grants_name_few_members_at_a_time(spark, monkeypatch):
    """Project grants come with the same rows as a plain join, block after block: neighbouring rows don't go through all of a project's resources."""
    monkeypatch.setattr(grants, "BLOCK", 8)
    monkeypatch.setattr(grants, "DEALT", 32)
    monkeypatch.setattr(grants, "WRITTEN", 500)
    held = spark.range(40).selectExpr("concat('m', id) AS source", "concat('p', id % 3) AS project", "CAST(NULL AS string) AS target", "'CanReadData' AS edge", "array('Bucket', 'Table') AS types", "'DATA' AS kind", "1D AS weight", "'get' AS permission", "1 AS ord", "id % 2 = 0 AS conditional", "array('f') AS facts")
    nodes = spark.range(200).selectExpr("concat('p', id % 4) AS account", "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Table' ELSE 'Bucket' END AS node_type", "concat('t', id) AS node_id", "concat('//t', id) AS arn")
    nodes = nodes.unionByName(nodes.limit(2))
    got = gcp.project_wide_edges(held, nodes)
    plain = held.withColumn("node_type", F.explode("types")).drop("target").join(nodes.selectExpr("account AS project", "node_type", "node_id AS target", "arn AS scope"), ["project", "node_type"]).select(*got.columns)
    assert sorted(got.collect()) == sorted(plain.collect())
    numbered = got.select("source", "target", F.spark_partition_id().alias("part")).collect()
    runs = [len({r["target"] for r in numbered[k : k + 24] if r["part"] == numbered[k]["part"]}) for k in range(0, len(numbered) - 24, 24)]
    assert len({r["part"] for r in numbered}) > 1 and sum(runs) / len(runs) <= 16


def test_edges_of_classes_come_in_blocks(spark, monkeypatch):
    """Edges of the binding and the scoped-role model are written out block after block too; what a resource's own grant gives doesn't reorder or repeat the others."""
    monkeypatch.setattr(grants, "BLOCK", 8)
    monkeypatch.setattr(grants, "DEALT", 32)
    monkeypatch.setattr(grants, "WRITTEN", 500)
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 40)
    buckets = nodes(spark, *[(f"gcp|p{k % 2}|gcp:storage:bucket|b{k}", "ObjectStorage", f"//storage/b{k}") for k in range(200)])
    role = ("role_permissions", "", "roles/r", "", {"permissions": ["storage.objects.get"]}, "gcp", "p1")
    bind = lambda who, target, level, p: ("iam_binding", "", f"user:u{who}@x.org", target, {"role": "roles/r", "condition": "x" if level == "project" else "", "level": level}, "gcp", p)
    project = [bind(k, f"p{k % 2}", "project", f"p{k % 2}") for k in range(20)]
    own = [bind(k, f"//storage/b{b}", "bucket", "p9") for k in range(0, 20, 2) for b in range(0, 200, 3)]
    edges, _ = gcp.gcp_permission_edges(facts(spark, role, *project, *own), buckets)
    rows = edges.select("source", "target", "state", F.spark_partition_id().alias("part")).collect()
    got = sorted((r["source"].split("|")[-1], r["target"].split("|")[-1], r["state"]) for r in rows)
    given = {(k, b) for k in range(0, 20, 2) for b in range(0, 200, 3)}
    assert got == sorted((f"u{k}@x.org", f"b{b}", "ACTIVE" if (k, b) in given else "CONDITIONAL") for k in range(20) for b in range(200) if (k, b) in given or k % 2 == b % 2)
    rest = [r for r in rows if r["state"] == "CONDITIONAL"]
    runs = [len({r["target"] for r in rest[k : k + 24]}) for k in range(0, len(rest) - 24, 24) if rest[k]["part"] == rest[k + 23]["part"]]
    assert len(runs) > 20 and sum(runs) / len(runs) <= 16
    best = spark.range(30).selectExpr("'c' AS class", "concat('p', id) AS source", "'CanReadSecret' AS edge", "false AS conditional", "named_struct('kind', 'DATA', 'weight', 1D, 'permission', 'get', 'facts', array('f')) AS f")
    members = spark.range(100).selectExpr("'c' AS class", "concat('v', id) AS target", "concat('/v', id) AS scope")
    many = grants.class_edges(best, members, "azure", "role-assignment").select("source", "target", F.spark_partition_id().alias("part")).collect()
    runs = [len({r["target"] for r in many[k : k + 24]}) for k in range(0, len(many) - 24, 24) if many[k]["part"] == many[k + 23]["part"]]
    assert len({(r["source"], r["target"]) for r in many}) == len(many) == 3000 and sum(runs) / len(runs) <= 16


def test_takeovers_of_containers_do_not_write_all_edges_again(spark):
    """All edges of assignments come in blocks, in one place of the plan; takeovers read the grants on containers by themselves."""
    vaults = [(f"azure|s1|azure:keyvault:vault|/subscriptions/s1/resourceGroups/rg/vault/v{k}", "Secret", f"/subscriptions/s1/resourceGroups/rg/vault/v{k}") for k in range(3)]
    owner = ("role_definition", "", "/x/own", "", {"actions": ["*"], "notActions": [], "dataActions": [], "notDataActions": []}, "azure")
    holds = ("role_assignment", "", "u1", "/subscriptions/s1", {"roleDefinitionId": "/x/own", "condition": ""}, "azure")
    edges, _ = azure.azure_permission_edges(facts(spark, owner, holds), nodes(spark, *vaults))
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("monotonically_increasing_id") == 1
    assert sorted(r["target"][-2:] for r in edges.where("type = 'CanControl' and nature = 'derived'").collect()) == ["v0", "v1", "v2"]
