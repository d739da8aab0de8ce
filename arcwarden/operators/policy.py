"""Policy documents as rows: statements, their matching, and three-valued conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.catalog import REQUEST_TIME_KEYS
from arcwarden.functions.scalars import C, account_of, col, fact_id, glob_match, ip_in_cidr, json_text, let, parse_condition_date, text

STATEMENT = "struct<Sid:string,Effect:string,Action:string,NotAction:string,Resource:string,NotResource:string,Principal:string,Condition:string>"


def strings(value: Column) -> Column:
    """A JSON string or array of strings as an array; empty for null."""
    listed = F.from_json(value, "array<string>")
    return F.when(value.isNull(), F.array().cast("array<string>")).when(value.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(value))


def _conditions(value: Column) -> Column:
    """``array<struct<op, key, values>>`` of a Condition object."""
    ops = F.map_entries(F.from_json(value, "map<string,map<string,string>>"))
    flat = F.flatten(F.transform(ops, lambda o: F.transform(F.map_entries(o["value"]), lambda k: F.struct(o["key"].alias("op"), k["key"].alias("key"), strings(k["value"]).alias("values")))))
    return F.coalesce(flat, F.array().cast("array<struct<op:string,key:string,values:array<string>>>"))


def parse_policy_statements(facts: DataFrame, keys: tuple[str, ...] = ("document", "policy")) -> DataFrame:
    """One row for each statement of the facts' documents; blank and unreadable documents have none.

    Columns: fact_id, kind, provider, account, source, target, at, sid, effect, actions, not_actions, resources, not_resources, public, principals, services,
    conditions. A single statement object counts as a list of one.
    """
    document = F.coalesce(*[F.nullif(F.trim(json_text("attributes", k)), F.lit("")) for k in keys])
    listed = F.get_json_object("doc", "$.Statement")
    statements = F.from_json(F.when(listed.startswith("{"), F.concat(F.lit("["), listed, F.lit("]"))).otherwise(listed), f"array<{STATEMENT}>")
    who = fact_id("provider", "kind", "source", "target", "edge_hint", "scope.account")
    rows = facts.select(who.alias("fact_id"), "kind", "provider", text("scope.account").alias("account"), "source", "target", document.alias("doc")).where("doc is not null")
    one = rows.select("fact_id", "kind", "provider", "account", "source", "target", F.posexplode(statements).alias("at", "s"))
    principal = F.col("s.Principal")
    by_type = F.from_json(F.when(principal.startswith("{"), principal), "map<string,string>")
    of = lambda t: strings(F.try_element_at(by_type, F.lit(t)))
    aws = F.when(principal.startswith("{"), of("AWS")).when(principal.isNull() | (principal == "*"), F.array().cast("array<string>")).otherwise(F.array(principal))
    starred = F.coalesce(F.exists(F.map_values(by_type), lambda v: F.array_contains(strings(v), "*")), F.lit(False))
    return one.select(
        "fact_id", "kind", "provider", "account", "source", "target", "at", F.col("s.Sid").alias("sid"), text("s.Effect").alias("effect"),
        strings(F.col("s.Action")).alias("actions"), strings(F.col("s.NotAction")).alias("not_actions"), strings(F.col("s.Resource")).alias("resources"), strings(F.col("s.NotResource")).alias("not_resources"),
        (F.coalesce(principal == "*", F.lit(False)) | starred).alias("public"), aws.alias("principals"), of("Service").alias("services"), _conditions(F.col("s.Condition")).alias("conditions"),
    )


def allows(effect: C = "effect") -> Column:
    return F.lower(text(effect)) == "allow"


def denies(effect: C = "effect") -> Column:
    return F.lower(text(effect)) == "deny"


def statement_action_match(action: Column) -> Column:
    """With NotAction: none of it matches; else any Action does. Without case."""
    any_of = lambda c: F.exists(c, lambda p: glob_match(p, action, fold=True))
    return F.when(F.size("not_actions") > 0, ~any_of("not_actions")).otherwise(any_of("actions"))


def statement_resource_match(resource: C) -> Column:
    """With NotResource: none of it matches; without any Resource: yes; else any does. With case."""
    r = col(resource)
    any_of = lambda c: F.exists(c, lambda p: glob_match(p, r))
    return F.when(F.size("not_resources") > 0, ~any_of("not_resources")).when(F.size("resources") == 0, F.lit(True)).otherwise(any_of("resources"))


def matched_actions(statements: DataFrame, actions: list[str]) -> DataFrame:
    """``statements`` once for each of the configured actions that they match, as ``action``."""
    hits = F.filter(F.array(*map(F.lit, actions)), statement_action_match)
    return statements.withColumn("action", F.explode(hits))


def principal_match_broad(principal: C) -> Column:
    """For denies: everyone, the principal, the root of its account, or a pattern."""
    p, account = col(principal), account_of(principal)
    root = lambda x: (account_of(x) == account) & (x.endswith(":root") | (x == account))
    return F.col("public") | F.exists("principals", lambda x: (x == p) | root(x) | glob_match(x, p))


def principal_match_direct(principal: C) -> Column:
    """For allows: everyone, the principal or a pattern, but never an account's root."""
    p = col(principal)
    return F.col("public") | F.exists("principals", lambda x: ~x.endswith(":root") & ((x == p) | glob_match(x, p)))


def principal_names_root(account: C) -> Column:
    a = col(account)
    return (a != "") & F.exists("principals", lambda x: (x == a) | (account_of(x) == a) & x.endswith(":root"))


# Conditions


def principal_context(principal: C) -> Column:
    """What is known of a request from its principal alone, by lower-case key."""
    account, p = F.nullif(account_of(principal), F.lit("")), F.nullif(text(principal), F.lit(""))
    pairs = [("aws:principalaccount", account), ("kms:calleraccount", account), ("aws:principalarn", p)]
    known = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.array(v).alias("value")) for k, v in pairs]), lambda e: F.get(e["value"], F.lit(0)).isNotNull())
    return F.map_from_entries(known)


_ORDER = ("Equals", "NotEquals", "LessThan", "LessThanEquals", "GreaterThan", "GreaterThanEquals")
_ALIKE = ("StringLike", "StringNotLike", "ArnEquals", "ArnLike", "ArnNotEquals", "ArnNotLike")
_EQUAL, _FOLDED, _ADDRESS = ("StringEquals", "StringNotEquals"), ("StringEqualsIgnoreCase", "StringNotEqualsIgnoreCase", "Bool"), ("IpAddress", "NotIpAddress")
_NEGATED = ("StringNotLike", "ArnNotEquals", "ArnNotLike", "StringNotEquals", "StringNotEqualsIgnoreCase", "NotIpAddress")
OPERATORS = (*_ALIKE, *_EQUAL, *_FOLDED, *_ADDRESS, *[f"{t}{o}" for t in ("Numeric", "Date") for o in _ORDER])


def _compare(op: Column, a: Column, p: Column) -> Column:
    """Whether a value satisfies a pattern under one of ``OPERATORS``. Every family appears once, as expressions are nested deeply."""
    number = lambda x: F.when(op.startswith("Date"), F.unix_micros(parse_condition_date(x)).cast("double")).otherwise(x.try_cast("double"))
    ordered = let(F.struct(number(a).alias("x"), number(p).alias("y"), F.regexp_replace(op, "^(Numeric|Date)", "").alias("o")), lambda s: F.coalesce(
        F.when(s["o"] == "Equals", s["x"] == s["y"]).when(s["o"] == "NotEquals", s["x"] != s["y"]).when(s["o"] == "LessThan", s["x"] < s["y"]).when(s["o"] == "LessThanEquals", s["x"] <= s["y"]).when(s["o"] == "GreaterThan", s["x"] > s["y"]).otherwise(s["x"] >= s["y"]), F.lit(False)))
    plain = F.when(op.isin(*_ALIKE), glob_match(p, a)).when(op.isin(*_EQUAL), a == p).when(op.isin(*_FOLDED), F.lower(a) == F.lower(p)).when(op.isin(*_ADDRESS), ip_in_cidr(a, p))
    return F.when(op.rlike("^(Numeric|Date)"), ordered).otherwise(plain != op.isin(*_NEGATED))


def eval_clause(op: C, key: C, values: C, known: C) -> Column:
    """0 true, 1 unresolved or 2 false for one operator, key and list of patterns."""
    raw, k, patterns = text(op), F.lower(text(key)), col(values)
    quantifier = F.when(raw.startswith("ForAllValues:"), "all").otherwise("any")
    plain = F.regexp_replace(raw, "^(ForAllValues|ForAnyValue):", "")
    if_exists, base = plain.endswith("IfExists"), F.regexp_replace(plain, "IfExists$", "")
    actual = F.try_element_at(col(known), k)
    later = k.isin(*REQUEST_TIME_KEYS)
    wants_absent = F.exists(patterns, lambda p: F.lower(p) == "true")
    null = F.when(actual.isNull() & later, F.lit(1)).when(wants_absent == actual.isNull(), F.lit(0)).otherwise(F.lit(2))
    hit = lambda a: F.exists(patterns, lambda p: F.coalesce(_compare(base, a, p), F.lit(False)))
    held = F.size(F.filter(actual, hit)) >= F.when(quantifier == "all", F.size(actual)).otherwise(F.lit(1))
    return (
        F.when(F.lower(base) == "null", null)
        .when(actual.isNull(), F.when(later, F.lit(1)).when(if_exists, F.lit(0)).otherwise(F.lit(2)))
        .when(~base.isin(*OPERATORS), F.lit(1)).when(held, F.lit(0)).otherwise(F.lit(2))
    )


def eval_conditions(conditions: C, known: C) -> Column:
    """All clauses together: false beats unresolved beats true; true without any."""
    return F.coalesce(F.array_max(F.transform(col(conditions), lambda c: eval_clause(c["op"], c["key"], c["values"], known))), F.lit(0))


def condition_labels(conditions: C) -> Column:
    return F.transform(col(conditions), lambda c: F.concat_ws(":", c["op"], c["key"]))


def has_condition_key(conditions: C, key: str) -> Column:
    return F.exists(col(conditions), lambda c: F.lower(c["key"]) == key)
