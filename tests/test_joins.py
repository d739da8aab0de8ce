"""Joins by pattern and by substring: the right pairs, and no plan that compares everything with everything."""

import numpy as np
import pytest
from helpers import nodes
from pyspark.sql import functions as F

from arcwarden import tables
from arcwarden.operators import assembly, aws, export, substrings
from arcwarden.operators import policy as P


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def all_against_all(frame):
    return [n for n in ("NestedLoop", "Cartesian") if n in plan_of(frame)]


PEOPLE = [f"arn:aws:iam::{a}:{kind}/{path}{name}" for a in ("111111111111", "222222222222") for kind in ("role", "user") for path in ("", "team/", "team/deep/") for name in ("ann", "bob-x", "x")] + ["odd", "", None]
GRANTS = [
    (1, False, ["arn:aws:iam::111111111111:role/ann"]), (2, False, ["arn:aws:iam::111111111111:*"]), (3, False, ["arn:aws:iam::*:role/team/*"]), (4, False, ["*ann"]), (5, True, ["*"]), (6, False, ["arn:aws:iam::222222222222:root"]),
    (7, False, ["arn:aws:iam::111111111111:role/t?am/deep/x", "arn:aws:iam::111111111111:role/team/deep/x", "*"]), (8, False, ["odd", "111111111111"]), (9, False, []), (10, True, []), (11, False, ["arn:aws:iam::1*:user/bob-*"]),
]


@pytest.mark.parametrize("limit", [tables.BROADCAST_ROWS, 0])
def test_named_people(spark, monkeypatch, limit):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", limit)
    people = spark.createDataFrame([(p,) for p in PEOPLE], "principal string")
    grants = spark.createDataFrame(GRANTS, "fact_id int, public boolean, principals array<string>")
    found = aws.named_people(grants, people)
    assert not all_against_all(found)
    want = people.where("principal is not null").join(grants, P.principal_match_direct("principal"))
    pairs = lambda df: sorted((r["fact_id"], r["principal"]) for r in df.collect())
    assert pairs(found) == pairs(want.distinct()) and len(pairs(found)) > 60


@pytest.mark.parametrize("limit", [tables.BROADCAST_ROWS, 0])
def test_containing(spark, monkeypatch, limit):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", limit)
    rng = np.random.default_rng(4)
    make = lambda n, least, most: ["".join(rng.choice(list("abé "), int(k))) for k in rng.integers(least, most, n)]
    texts, patterns = make(80, 0, 40) + [None, "a"], make(80, 1, 20) + ["", None, "zz"]
    found = substrings.containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert not all_against_all(found)
    assert {tuple(r) for r in found.collect()} == {(t, p) for t in texts if t for p in patterns if p and p in t}


def test_plans_without_nested_loops(spark, monkeypatch):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    given = nodes(spark, ("aws|1|aws:iam:role|r1", "Role", "arn:aws:iam::1:role/deep/r1"), ("aws|1|aws:iam:role|r2", "Role", "arn:aws:iam::1:role/r2"))
    marked = assembly.mark_footholds(given, spark.createDataFrame([("deep/r1",), ("r2",), ("r",), ("x@p1.iam.gserviceaccount.com",)], "caller string"))
    feet = {r["node_id"]: r["foothold"] for r in marked.collect()}
    assert feet["aws|1|aws:iam:role|r1"] and feet["aws|1|aws:iam:role|r2"] and len(feet) == 3 and not all_against_all(marked)
    facts = spark.createDataFrame([("f1", "iam_role"), ("f2", "bucket"), ("f3", ""), ("f4", "s3Bucket")], "fact_id string, fact_type string")
    evidence = spark.createDataFrame([("e1", "role"), ("e2", "aws:s3:bucket"), ("e3", None)], "evidence_id string, resource_type string")
    linked = export.fact_evidence_link(facts, evidence)
    plain = facts.join(evidence, F.lit(True)).select("*", export.norm_type("fact_type").alias("f"), export.norm_type("resource_type").alias("r")).where("f != '' and r != '' and (contains(f, r) or contains(r, f))")
    assert {tuple(r) for r in linked.collect()} == {(r["fact_id"], r["evidence_id"]) for r in plain.collect()} and not all_against_all(linked)
