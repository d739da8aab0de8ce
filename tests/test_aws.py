"""Statement-model scenarios: deny wins, gates, both sides across accounts, keys, conditions."""

import pytest
from tests.helpers import allow, deny, doc, facts, nodes

from arcwarden.operators import policy as P
from arcwarden.operators.aws import aws_permission_edges

READ = "secretsmanager:GetSecretValue"
MFA = {"BoolIfExists": {"aws:MultiFactorAuthPresent": "false"}}
SOURCE = {"IpAddress": {"aws:SourceIp": "10.0.0.0/8"}}


class Case:
    """An account of its own for each case: a user, a role of another account, a secret, a key and a bucket."""

    def __init__(self, n: int):
        a, b = f"{n:012d}", f"{n + 500:012d}"
        self.n, self.account = n, a
        self.jo, self.far = f"arn:aws:iam::{a}:user/jo{n}", f"arn:aws:iam::{b}:role/far{n}"
        self.root, self.far_root = f"arn:aws:iam::{a}:root", f"arn:aws:iam::{b}:root"
        self.secret, self.key, self.bucket = f"arn:aws:secretsmanager:eu-1:{a}:secret:s{n}", f"arn:aws:kms:eu-1:{a}:key/k{n}", f"arn:aws:s3:::b{n}"
        self.nodes = [(f"aws|{a}|aws:iam:user|jo{n}", "HumanIdentity", self.jo), (f"aws|{b}|aws:iam:role|far{n}", "Role", self.far), (f"aws|{a}|aws:secretsmanager:secret|s{n}", "Secret", self.secret), (f"aws|{a}|aws:kms:key|k{n}", "EncryptionKey", self.key), (f"aws|{a}|aws:s3:bucket|b{n}", "ObjectStorage", self.bucket)]


def inline(who, *statements):
    return ("identity_policy", "HasPermission", who, "", {"document": doc(*statements)})


def attached(what, *statements):
    return ("resource_policy", "", what, "", {"policy": doc(*statements)})


def scenarios(c):
    """Facts of each case, by number."""
    group, policy = f"arn:aws:iam::{c[10].account}:group/g", f"arn:aws:iam::{c[10].account}:policy/p"
    mine = lambda k: inline(c[k].far, allow(READ, c[k].secret))
    theirs = lambda k: attached(c[k].secret, allow(READ, None, Principal={"AWS": c[k].far}))
    use = lambda k: inline(c[k].jo, allow("kms:Decrypt", c[k].key))
    return [
        inline(c[1].jo, allow(READ, c[1].secret), allow("s3:Get*", c[1].bucket + "/*")),
        inline(c[2].jo, allow("*", "*"), deny(READ, "*")),
        inline(c[3].jo, {"Effect": "Allow", "NotAction": "s3:*", "Resource": "*"}),
        inline(c[4].jo, {"Effect": "Allow", "Action": READ, "NotResource": c[4].secret}),
        inline(c[5].jo, allow(READ, c[5].secret), deny("*", "*", Condition=MFA)),
        inline(c[6].jo, allow(READ, c[6].secret, Condition=SOURCE)),
        inline(c[7].jo, allow(READ, c[7].secret, Condition=SOURCE), allow(READ, "*")),
        inline(c[8].jo, allow(READ, c[8].secret, Condition={"StringEquals": {"aws:PrincipalAccount": "999999999999"}})),
        inline(c[9].jo, allow("*", "*")), ("scp", "", "p", "", {"document": doc(allow("s3:*", "*"))}, "aws", c[9].account),
        ("membership", "MemberOf", c[10].jo, group, {}), ("membership", "HasPolicy", group, policy, {}), ("managed_policy", "", policy, "", {"document": doc(allow(READ, "*"))}),
        inline(c[11].jo, allow("*", "*")), ("permission_boundary", "", c[11].jo, "", {"document": doc(allow(READ, "*"))}),
        mine(12), theirs(13), mine(14), theirs(14), mine(15), attached(c[15].secret, allow(READ, None, Principal={"AWS": c[15].far_root})),
        attached(c[16].secret, allow(READ, None, Principal="*")), mine(17), attached(c[17].secret, allow(READ, None, Principal={"AWS": c[17].far}), deny(READ, None, Principal={"AWS": f"{517:012d}"})),
        use(18), attached(c[19].key, allow("kms:*", "*", Principal={"AWS": c[19].root})), attached(c[20].key, allow("kms:*", "*", Principal={"AWS": c[20].root})), use(20),
        attached(c[21].key, allow("kms:*", "*", Principal="*", Condition={"StringEquals": {"kms:ViaService": "x"}})), use(21), attached(c[22].key, allow("kms:*", "*", Principal={"AWS": c[22].jo})),
    ]


@pytest.fixture(scope="module")
def found(spark):
    cases = {n: Case(n) for n in range(1, 23)}
    graph = nodes(spark, *[x for c in cases.values() for x in c.nodes])
    rows = aws_permission_edges(facts(spark, *scenarios(cases)), graph).collect()
    held = {(r["type"], r["source"].split("|")[-1], r["target"].split("|")[-1]): r for r in rows}
    return lambda n, who="jo", edge="CanReadSecret", what="s": held.get((edge, f"{who}{n}", f"{what}{n}"))


def test_allow_and_deny(found):
    assert found(1)["state"] == "ACTIVE" and found(1)["scope"].endswith("secret:s1") and len(found(1)["facts"]) == 1
    assert found(1, edge="CanReadData", what="b") and not found(1, edge="CanWriteData", what="b")
    assert not found(2) and found(2, edge="CanReadData", what="b")
    assert found(3) and not found(3, edge="CanReadData", what="b") and not found(4)


def test_conditions(found):
    assert found(5)["state"] == "CONDITIONAL" and found(5)["confidence"] == 0.5 and found(5)["conditions"] == ["BoolIfExists:aws:MultiFactorAuthPresent"]
    assert found(6)["state"] == "CONDITIONAL" and found(7)["state"] == "ACTIVE" and not found(8)


def test_gates_and_groups(found):
    assert not found(9) and found(9, edge="CanReadData", what="b")
    assert found(10) and found(11) and not found(11, edge="CanReadData", what="b")


def test_cross_account_needs_both(found):
    assert not found(12, "far") and not found(13, "far") and found(14, "far")["state"] == "ACTIVE" and not found(15, "far")
    assert found(16) and not found(16, "far") and not found(17, "far")


def test_keys(found):
    key = lambda n: found(n, edge="CanDecrypt", what="k")
    assert key(18)["state"] == "CONDITIONAL" and key(18)["conditions"] == ["key_policy_unknown"]
    assert not key(19) and key(20)["state"] == "ACTIVE" and not key(21) and key(22)["state"] == "ACTIVE"


KNOWN = {"aws:principalaccount": ["1"], "k": ["a", "b"], "n": ["5"], "d": ["2024-01-02T00:00:00Z"], "ip": ["10.1.1.1"]}


@pytest.mark.parametrize(
    ("op", "key", "values", "want"),
    [
        ("StringEquals", "K", ["b"], 0), ("StringEquals", "k", ["c"], 2), ("StringNotEquals", "k", ["a"], 0), ("StringLike", "k", ["?"], 0), ("StringEqualsIgnoreCase", "k", ["A"], 0), ("StringEquals", "absent", ["a"], 2), ("StringEqualsIfExists", "absent", ["a"], 0),
        ("BoolIfExists", "aws:MultiFactorAuthPresent", ["false"], 1), ("IpAddress", "aws:SourceIp", ["0.0.0.0/0"], 1), ("IpAddress", "ip", ["10.0.0.0/8"], 0), ("NotIpAddress", "ip", ["10.0.0.0/8"], 2), ("NumericLessThan", "n", ["6"], 0), ("NumericEquals", "n", ["x"], 2),
        ("DateGreaterThan", "d", ["2024-01-01T00:00:00Z"], 0), ("DateLessThan", "d", ["0"], 2), ("ForAllValues:StringEquals", "k", ["a"], 2), ("ForAllValues:StringEquals", "k", ["a", "b"], 0), ("ForAnyValue:StringEquals", "k", ["b"], 0), ("BinaryEquals", "k", ["a"], 1),
        ("Null", "k", ["false"], 0), ("Null", "k", ["true"], 2), ("Null", "absent", ["true"], 0), ("Null", "aws:SourceIp", ["true"], 1), ("ArnLike", "k", ["a*"], 0),
    ],
)
def test_clauses(spark, op, key, values, want):
    known = spark.createDataFrame([(KNOWN, op, key, values)], "known map<string,array<string>>, op string, key string, v array<string>")
    assert known.select(P.eval_clause("op", "key", "v", "known").alias("x")).first()["x"] == want


def test_false_beats_unresolved(spark):
    cond = [("StringEquals", "absent", ["a"]), ("IpAddress", "aws:SourceIp", ["0.0.0.0/0"])]
    df = spark.createDataFrame([(KNOWN, cond), (KNOWN, cond[1:]), (KNOWN, [])], "known map<string,array<string>>, c array<struct<op:string,key:string,values:array<string>>>")
    assert [r["x"] for r in df.select(P.eval_conditions("c", "known").alias("x")).collect()] == [2, 1, 0]
