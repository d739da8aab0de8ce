"""De-identification: nothing real survives, look-alikes of fakes included; texts are rewritten as a plain version does it."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwarden.operators import redact as R
from arcwarden.operators import substrings
from arcwarden.tables import stored

SALT = b"0123456789abcdef0123456789abcdef"
BAG = {
    "name": "Acme Payments", "email": "jane.doe@corp.com", "ip": "10.1.2.3", "host": "host-42.prod.corp.com", "owner": "user-service@corp.com", "node_type": "Role", "size": "7",
    "tags": {"team": "node-7.prod.corp.com", "n": "12"}, "note": "ask Acme Payments at host-42.prod.corp.com or jane.doe; see https://wiki.corp.com/x?y=1 from 10.1.2.3, not Acme Paymentsville",
}
REAL = ["Acme Payments", "jane.doe", "10.1.2.3", "host-42.prod", "user-service", "node-7.prod", "wiki.corp.com", "999988887777", "res-prod-db", "proj-x"]


@pytest.fixture
def frames(spark):
    nodes = spark.createDataFrame(
        [("aws|999988887777|aws:rds:db|res-prod-db", "RelationalDatabase", "aws", "999988887777", "arn:aws:rds:eu:999988887777:db/res-prod-db", json.dumps(BAG)), ("gcp|proj-x|gcp:iam:user|jane.doe@corp.com", "HumanIdentity", "gcp", "proj-x", None, None), (None, None, None, None, None, "no json, jane.doe@corp.com")],
        "node_id string, node_type string, provider string, account string, arn string, attributes string",
    )
    edges = spark.createDataFrame(
        [("e_1", "CanReadData", "gcp|proj-x|gcp:iam:user|jane.doe@corp.com", "aws|999988887777|aws:rds:db|res-prod-db", "jane.doe@corp.com reads res-prod-db of proj-x", ["StringEquals:jane.doe@corp.com"]), ("e_2", "CanAssume", None, None, None, None)],
        "edge_id string, type string, source string, target string, narrative string, conditions array<string>",
    )
    return {"nodes": nodes, "edges": edges}


def test_nothing_real_survives(frames):
    out, audit, fine = R.redact_graph(frames, SALT)
    said = "\n".join(json.dumps(r.asDict(), default=str) for df in out.values() for r in df.collect())
    assert [x for x in REAL if x in said] == []
    assert fine and audit["leaks"].count() == 0 and audit["shape"].count() == 0
    bag = json.loads(next(r["attributes"] for r in out["nodes"].collect() if r["attributes"] and r["attributes"].startswith("{")))
    assert bag["node_type"] == "Role" and bag["size"] == "7" and bag["tags"]["n"] == "12" and list(bag) == sorted(BAG) and bag["name"] in bag["note"] and bag["ip"] in bag["note"]
    ids = {r["node_id"] for r in out["nodes"].collect()}
    assert {r["source"] for r in out["edges"].collect()} <= ids and {r["target"] for r in out["edges"].collect()} <= ids
    again, _, _ = R.redact_graph(frames, SALT)
    assert sorted(map(str, again["nodes"].collect())) == sorted(map(str, out["nodes"].collect()))


def test_audit_finds_what_stays(frames):
    leaks = {(r["file"], r["token"]) for r in R.leak_audit(frames, frames).collect()}
    assert {("nodes", "jane.doe@corp.com"), ("edges", "res-prod-db"), ("nodes", "host-42.prod.corp.com"), ("nodes", "Acme Payments")} <= leaks
    shape = R.isomorphism_check(frames, {"nodes": frames["nodes"].where("node_type = 'Role'"), "edges": frames["edges"]})
    assert {r["problem"] for r in shape.collect()} == {"count", "node_type", "dangling"}


def plain_scrub(text, mapping):
    """Nested replacement, longest first; the fakes hold nothing that is replaced."""
    if text.strip() in mapping:
        return mapping[text.strip()]
    for real in sorted((m for m in mapping if len(m) >= 4), key=lambda m: (-len(m), m)):
        text = text.replace(real, mapping[real])
    return text


def test_scrub_against_plain_version(spark):
    """Identifiers inside words, overlapping ones, ones in others, on both sides of chunks."""
    rng = np.random.default_rng(8)
    parts = ["alpha", "beta", "alpha beta", "gam-ma", "beta gam-ma", "x1", "abc", "delta_9", "habet", "betabeta", "acmeprod", "a-very-long-identifier-of-forty-characters", "a-very-long-identifier-of-more", "éèêë"]
    mapping = {p: f"<{k}>" for k, p in enumerate(parts)}
    texts = ["".join(rng.choice([*parts, "alphabet", " ", "-", ", ", "é", ".", "\n"], int(rng.integers(0, 14)))) for _ in range(300)]
    texts += [None, "", "abc", " x1 ", "x1 y", "acmeprodlogs", "my_acmeprod_bucket", "z" * (substrings.CHUNK - 3) + "acmeprod" + "alpha" * 20_000]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    known = spark.createDataFrame(list(mapping.items()), "real string, fake string")
    got = {r["k"]: r["t"] for r in R.scrub_known(frame, known, ("t",)).collect()}
    assert got == {k: None if t is None else plain_scrub(t, mapping) for k, t in enumerate(texts)}
    assert R.scrub_known(frame.where("false"), known, ("t",)).count() == 0 and R.scrub_known(frame, known.where("false"), ("t",)).where("t is not null").join(frame, ["k", "t"]).count() == frame.where("t is not null").count()


def test_anchors_tell_patterns_apart(spark):
    """Patterns with a common start have anchors elsewhere; every pattern has one."""
    patterns = spark.createDataFrame([(f"arn:aws:iam::role/{k:03d}x",) for k in range(200)] + [("abcd",), ("abc",), (None,), ("abcd",)], "pattern string")
    found = substrings.anchored(patterns).collect()
    assert len(found) == 201 and len({r["h"] for r in found}) == 201


def test_audit_looks_inside_words(spark):
    before = {"nodes": spark.createDataFrame([("acmeprod", "Role"), ("jane.doe@corp.com", "Role"), ("tiny", "Role")], "name string, node_type string")}
    after = {"nodes": spark.createDataFrame([("see acmeprodlogs", "Role"), ('{"a":"xjane.doe@corp.comx"}', "Role"), ("tiny", "acmepro d")], "name string, node_type string")}
    assert {r["token"] for r in R.leak_audit(before, after).collect()} == {"acmeprod", "jane.doe@corp.com", "corp.com", "jane.doe"} - ({"corp.com", "jane.doe"} - {r["token"] for r in R.real_tokens(before).collect()})
    assert R.leak_audit(before, {"nodes": after["nodes"].where("name = 'tiny'")}).count() == 0 and R.leak_audit({"nodes": before["nodes"].where("false")}, after).count() == 0


def test_residual_sweep(spark):
    texts = ["mail x.y@corp.com or https://wiki.corp.com:8080/a?b#c", "10.1.2.3/24 and 10.1.2.3, not 999.1.1.1", "arn:aws:iam::123456789012:role/deep/one", "arn:aws:iam::aws:policy/ReadOnly stays, so does 0.0.0.0/0", "kept-fake.example.org", None, "", "nothing"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["t"] for r in R.scrub_residual(frame, SALT, "t", fakes=spark.createDataFrame([("kept-fake.example.org",)], "fake string")).collect()}
    assert got[0] == f"mail {R.fake_for(SALT, 'x.y@corp.com', 'user_email')} or https://{R.fake_for(SALT, 'wiki.corp.com:8080', 'hostname')}/x"
    assert got[1] == f"{R.prefix_preserving_ip(SALT, '10.1.2.3/24')} and {R.prefix_preserving_ip(SALT, '10.1.2.3')}, not 999.1.1.1"
    assert got[2] == R.fake_for(SALT, texts[2], "arn") and "deep" not in got[2] and [got[k] for k in (3, 4, 5, 6, 7)] == texts[3:]


def test_fakes_keep_types_and_prefixes():
    for real, kind in (("a@b.org", "user_email"), ("h.b.org", "hostname"), ("123456789012", "aws_account"), ("8c1d2f3a-0000-4000-8000-000000000001", "guid"), ("10.0.0.0/8", "cidr"), ("fe80::1", "ip"), ("x@p.iam.gserviceaccount.com", "sa_email")):
        assert R.classify(R.fake_for(SALT, real, kind)) == kind and R.fake_for(SALT, real, kind) != real or kind == "cidr"
    a, b = R.prefix_preserving_ip(SALT, "10.1.2.3").split("."), R.prefix_preserving_ip(SALT, "10.1.2.9").split(".")
    assert a[:3] == b[:3] and a[0] == "10" and R.prefix_preserving_ip(SALT, "0.0.0.0/0") == "0.0.0.0/0"


def test_fakes_of_accounts_hold_no_identifier(spark):
    """Where all numbers of five digits are identifiers, accounts get fakes of twelve digits without any, each its own, in arns as well."""
    numbers = spark.range(10_000, 100_000).selectExpr("cast(id as string) AS real", "'resource' AS type")
    own = spark.createDataFrame([(f"{k}", "aws_account") for k in range(5)] + [(f"arn:aws:iam::{k}:role/x", "arn") for k in range(5)], "real string, type string")
    got = {r["real"]: r["fake"] for r in R.identifier_map(numbers.unionByName(own), SALT).where("type in ('aws_account', 'arn')").collect()}
    fakes = [got[f"{k}"] for k in range(5)]
    assert len(set(fakes)) == 5 and all(len(f) == 12 and f[:8] == "0" * 8 and f.isdigit() for f in fakes)
    assert [got[f"arn:aws:iam::{k}:role/x"].split(":")[4] for k in range(5)] == fakes


def test_numbers_come_back_only_where_they_stand(spark):
    """Identifiers that share all their short n-grams: a text gets those that it holds, not all that share an n-gram with it."""
    known = spark.range(10_000, 12_000).selectExpr("cast(id as string) AS pattern")
    anchors = substrings.anchored(known)
    assert substrings.widths_of(anchors) == [5]
    sent = list(substrings.sent_grams([(1, ["about 10555"]), (2, ["x10111999"]), (3, ["none"])], [5]))
    grams = spark.createDataFrame([(r, h) for b in sent for r, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], "r long, h long")
    assert sorted((x["r"], x["pattern"]) for x in grams.join(anchors, "h").collect()) == [(1, "10555"), (2, "10111"), (2, "11199"), (2, "11999")]


def test_lookalikes_are_what_the_patterns_find(spark):
    """Texts without a sign of an identifier aren't tried, nor do they go to Python; nothing is lost by that."""
    kinds = ["arn:aws:iam::123456789012:role/x", "arn:aws::::é", "http://é", "https://a", "x@gserviceaccount.com", "x@p-1.iam.gserviceaccount.com", "a%b@c.de", "10.1.0.0/16", "1.2.3.4", "a:b:c", "FE80:0:1::1", "0:1:2", "01234567-89ab-cdef-0123-456789ABCDEF", "123456789012", "a-.io", "Host.Example"]
    plain = ["", None, "one two", "a. b", "12:30", "3.5", "1234567890123", "end.", "a-b-c", "x:/y", "a.b", "::", "12345678-1234-"]
    texts = [*kinds, *plain, *(f"({a}) {b}\n{c}." for a, b, c in zip(kinds, reversed(kinds), plain, strict=False)), *(f"{a}{b}" for a, b in zip(kinds, kinds[1:], strict=False))]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = frame.select("t", R.lookalikes("t").alias("got"), F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(R.ANY_PATTERN), F.lit(0)).alias("all")).collect()
    assert all(r["got"] == r["all"] for r in rows) and all(r["all"] for r in rows[: len(kinds)])
    swept = R.scrub_residual(frame, SALT, "t")
    assert "Union" in swept._jdf.queryExecution().optimizedPlan().toString()
    found = {r["k"]: r["t"] for r in swept.collect()}
    assert len(found) == len(texts) and [t for k, t in enumerate(texts) if (found[k] == t) == bool(rows[k]["all"])] == []


def test_few_grams_are_sent(spark):
    """The sieve lets all anchors and whole identifiers through that stand in a text, on both sides of pieces, and hardly anything else."""
    rng = np.random.default_rng(5)
    known = ["".join(rng.choice(list("abcdefghij.@0123"), int(k))) for k in rng.integers(4, 30, 300)] + ["éèêëïîôû", "plain text"]
    noise = ["".join(rng.choice(list("klmnopqrstuvwxyz ,"), 400)) for _ in range(200)]
    texts = [f"{n[:200]}{p}{n[200:]}" for n, p in zip(noise, known, strict=False)] + [f" {p}\n" for p in known] + ["", "z" * (substrings.CHUNK - 2) + known[0] + "z" * 9 + known[1], "".join(known)]
    patterns = spark.createDataFrame([(p,) for p in known], "pattern string")
    anchors = substrings.anchored(patterns)
    held = {r["pattern"]: r["h"] for r in anchors.collect()}
    whole = {substrings.text_hash(p) for p in known}
    entries = stored(anchors.select("h").union(patterns.select(F.xxhash64("pattern"))), "entries")
    widths = substrings.widths_of(anchors)
    pairs = lambda *sieve: {(r, h) for b in substrings.sent_grams(((k, [t]) for k, t in enumerate(texts)), widths, *sieve) for r, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    got, every = pairs(substrings.sieve_of(anchors, entries)), pairs()
    wanted = {(k, h) for k, t in enumerate(texts) for p, h in held.items() if p in t} | {(k, substrings.text_hash(t.strip())) for k, t in enumerate(texts) if substrings.text_hash(t.strip()) in whole}
    assert wanted <= got <= every and len(got) < len(wanted) + len(every) / 500


def test_texts_without_identifiers_stay_out_of_python(spark):
    """Only rows that hold an identifier are rewritten, and no shuffle moves texts where few identifiers are held."""
    frame = spark.createDataFrame([(k, "ask jane.doe" if k == 3 else f"nothing {k}") for k in range(20)] + [(20, None)], "k int, t string")
    scrubbed = R.scrub_known(frame, spark.createDataFrame([("jane.doe", "<j>")], "real string, fake string"), ("t",))
    plan = scrubbed._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "SortMergeJoin" not in plan
    assert {r["k"]: r["t"] for r in scrubbed.collect()} == {k: "ask <j>" if k == 3 else f"nothing {k}" for k in range(20)} | {20: None}
