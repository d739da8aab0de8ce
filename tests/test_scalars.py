"""Literal cases of the column functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from arcwarden.functions import scalars as S


@pytest.fixture(scope="module")
def ask(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_ids(ask):
    want = "e_" + hashlib.sha256(b"CanAssume|a|b|").hexdigest()[:16]
    assert ask(S.edge_id(*lit("CanAssume", "a", "b", None))) == want
    assert ask(S.node_id(*lit("aws", "1", None, "x"))) == "aws|1||x"
    assert ask(S.fact_id(*lit("aws", "scp", "s", "", "", "1"))) == "fact-" + hashlib.sha256(b"aws|scp|s|||1").hexdigest()[:12]


@pytest.mark.parametrize(("arn", "account"), [("arn:aws:iam::123456789012:role/x", "123456789012"), ("arn:aws:s3:::bucket", ""), ("123456789012", "123456789012"), ("12345678901", ""), ("arn:aws", ""), (None, "")])
def test_account_of(ask, arn, account):
    assert ask(S.account_of(F.lit(arn))) == account


@pytest.mark.parametrize(
    ("pattern", "subject", "fold", "want"),
    [("s3:*", "s3:GetObject", True, True), ("S3:get*", "s3:GetObject", True, True), ("s3:Get?bject", "s3:GetObject", False, True), ("s3:*Object", "s3:GetObject", False, True), ("*", "", False, True), ("a.c", "abc", False, False), ("a*c*e", "abcde", False, True),
     ("a*c*e", "abcdef", False, False), ("arn:aws:s3:::b/*", "arn:aws:s3:::b/*", False, True), ("[x]+", "[x]+", False, True), ("*b", "ab", False, True), ("s3:Get", "s3:GetObject", False, False), ("a?", "a", False, False)],
)
def test_glob(ask, pattern, subject, fold, want):
    assert ask(S.glob_match(F.lit(pattern), F.lit(subject), fold)) is want


def test_azure_wildcards(ask):
    match = lambda p, a: ask(S.azure_wildcard_match(*lit(p, a)))
    assert match("Microsoft.KeyVault/*", "microsoft.keyvault/vaults/secrets/getSecret/action")
    assert match("Microsoft.Storage/*/read", "Microsoft.Storage/storageAccounts/read") and match("Microsoft.Storage/*/read", "Microsoft.Storage/read")
    assert not match("Microsoft.Storage/?", "Microsoft.Storage/x") and not match("*/write", "x/read")


@pytest.mark.parametrize(
    ("ip", "cidr", "want"),
    [("10.1.2.3", "10.0.0.0/8", True), ("11.1.2.3", "10.0.0.0/8", False), ("10.1.2.3", "10.1.2.3", True), ("10.1.2.3", "0.0.0.0/0", True), ("2001:db8::1", "2001:db8::/32", True), ("2001:db9::1", "2001:db8::/32", False), ("::1", "::1", True), ("2001:db8::1", "2001:db8:0:0:0:0:0:1", True),
     ("x", "10.0.0.0/8", False), ("10.1.2.3", "10.0.0.0/x", False), ("10.1.2.3", "2001:db8::/32", False), ("192.168.1.77", "192.168.1.64/26", True), ("256.1.1.1", "0.0.0.0/0", False)],
)
def test_ip_in_cidr(ask, ip, cidr, want):
    assert ask(S.ip_in_cidr(*lit(ip, cidr))) is want


def test_names(ask):
    assert ask(S.node_short(F.lit("aws|1|t|arn:aws:iam::1:role/a/b"))) == "b" and ask(S.node_short(F.lit("name|service:ec2.example"))) == "service:ec2.example"
    assert ask(S.norm_identity(F.lit("Jo.Ann_Lee@x.org"))) == "jo ann lee"
    assert ask(S.norm_type(F.lit("gcp:iam:Service-Accounts"))) == "serviceaccount"
    assert ask(S.endpoint_type(F.lit("10.0.0.0/8"))) == "CIDR" and ask(S.endpoint_type(F.lit("sg-1"))) == "SecurityGroup" and ask(S.endpoint_type(F.lit("x"))) == "Unknown"
    assert ask(S.label(F.lit("a|b|c|x/y"), F.lit('{"alias":"alias/k"}'))) == "k" and ask(S.label(F.lit("a|b|c|x/y"), F.lit('{"displayName":"Z"}'))) == "Z" and ask(S.label(F.lit("a|b|c|x/y"), F.lit(None).cast("string"))) == "y"
    assert ask(S.cluster_of(*lit("aws|1|aws:kms:key|k", "EncryptionKey"))) == "kms" and ask(S.cluster_of(*lit("name|sg-1", "SecurityGroup"))) == "ec2" and ask(S.cluster_of(*lit("name|10.0.0.0/8", "CIDR"))) == "network"
    assert ask(S.service_of_resource(*lit("arn|arn:aws:s3:::b", "arn:aws:s3:::b"))) == "s3"
    assert ask(S.is_admin(*lit("a|b|c|x", "arn:aws:iam::1:root"))) is True or ask(S.is_admin(*lit("arn:aws:iam::1:root", None))) is True
    assert ask(S.role_def_key(F.lit("/x/roleDefinitions/ABC"))) == "abc" and ask(S.sub_of(F.lit("/subscriptions/S1/x"))) == "s1" and ask(S.rg_scope_of(F.lit("/subscriptions/s/resourceGroups/r/p"))) == "/subscriptions/s/resourceGroups/r"


def test_members(ask):
    split = lambda m: ask(S.split_member(F.lit(m)))
    assert tuple(split("user:a@b.org")) == ("user", "a@b.org") and tuple(split("allUsers")) == ("allUsers", "") and split("deleted:user:a@b.org?uid=1") is None and split("odd") is None
    realm = lambda k, v: ask(S.identity_realm(*lit(k, v)))
    assert realm("serviceAccount", "x@p1.iam.gserviceaccount.com") == "p1" and realm("serviceAccount", "1@developer.gserviceaccount.com") == "external" and realm("user", "a@b.org") == "b.org" and realm("allUsers", "") == "public"
    agent = lambda m: ask(S.is_provider_managed(F.lit(m)))
    assert agent("serviceAccount:service-12@x.iam.gserviceaccount.com") and agent("serviceAccount:1@cloudservices.gserviceaccount.com") and not agent("serviceAccount:mine@p1.iam.gserviceaccount.com")


def test_scopes(ask):
    covers = lambda s, i: ask(S.scope_contains(*lit(s, i)))
    assert covers("/subscriptions/A", "/subscriptions/a/x") and covers("/", "/x") and not covers("", "/x") and not covers("/subscriptions/a", "/subscriptions/ab")


def test_values(ask):
    assert ask(S.shannon_entropy(F.lit("abcd"))) == pytest.approx(2.0) and ask(S.shannon_entropy(F.lit(""))) == 0
    assert ask(S.b64_text(*lit("aGVsbG8=", "ec2.UserData"))) == "hello" and ask(S.b64_text(*lit("aGVsbG8=", "other"))) == "aGVsbG8=" and ask(S.b64_text(*lit("gICA", "UserData"))) == "gICA"
    assert ask(S.preview(F.lit(" a \n b "), 10)) == "a b" and ask(S.preview(F.lit("abcdef"), 3)) == "abc…"
    assert ask(S.parse_condition_date(F.lit("2024-01-01T00:00:00Z"))).year == 2024 and ask(S.parse_condition_date(F.lit("0"))).year == 1970 and ask(S.parse_condition_date(F.lit("soon"))) is None
    known = {"aws:username": F.lit("jo")}
    assert ask(S.glob_match(S.expand_policy_vars(F.lit("home/${aws:username}/${*}"), known), F.lit("home/jo/*"))) and not ask(S.glob_match(S.expand_policy_vars(F.lit("home/${aws:username}/${*}"), known), F.lit("home/jo/x"))) and ask(S.expand_policy_vars(F.lit("${other}"), known)) is None
