"""Effective permissions in the statement model: deny wins, then service control policies, boundary, identity and resource.

Nothing is multiplied blindly. Statements are matched with the configured actions first; exact resources meet resources by
equality, and only patterns are compared, within the action's node types; pairs exist where some allow names both sides.
Then denies and gates remove pairs by joins on principal, account or resource.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.catalog import AWS_CAPABILITIES, AWS_SERVICE_OVERRIDES, PRINCIPAL_TYPES
from arcwarden.functions.scalars import account_of, blank, edge_id, glob_class, glob_match, service_of_resource
from arcwarden.operators import policy as P
from arcwarden.tables import config_frame, small, stored

ACTIONS = [c[1] for c in AWS_CAPABILITIES]
PAIR = ["principal", "action", "target_arn"]
STATEMENT = ["fact_id", "at", "actions", "not_actions", "resources", "not_resources", "public", "principals", "conditions", "action"]


def capabilities(spark) -> DataFrame:
    rows = [(k, edge, action, list(types), kind, weight, suffix, AWS_SERVICE_OVERRIDES.get(action, action.split(":")[0])) for k, (edge, action, types, kind, weight, suffix) in enumerate(AWS_CAPABILITIES)]
    return config_frame(spark, rows, "ord int, edge string, action string, types array<string>, kind string, weight double, suffix string, service string")


@dataclass(frozen=True)
class Policies:
    """Stored statements with the actions that they match (``hits``), and memberships."""

    statements: DataFrame
    members: DataFrame

    def of(self, kind: str) -> DataFrame:
        return self.statements.where(F.col("kind") == kind)


def load_policies(facts: DataFrame) -> Policies:
    """Every document parsed, and matched with the configured actions, once."""
    kinds = ("identity_policy", "managed_policy", "resource_policy", "scp", "permission_boundary")
    rows = P.parse_policy_statements(facts.where(F.col("kind").isin(*kinds)), ("policy", "document"))
    hits = F.filter(F.array(*map(F.lit, ACTIONS)), P.statement_action_match)
    return Policies(stored(rows.withColumn("hits", hits), "statements"), stored(facts.where("kind = 'membership'").select("edge_hint", "source", "target").distinct(), "members"))


def _matched(statements: DataFrame) -> DataFrame:
    return statements.withColumn("action", F.explode("hits"))


def principal_statements(policies: Policies) -> DataFrame:
    """Statements of each principal: inline, attached, and those of its groups; a managed document once."""
    inline = policies.of("identity_policy").withColumn("principal", F.col("source"))
    managed = policies.of("managed_policy")
    has = policies.members.where("edge_hint = 'HasPolicy'").select(F.col("source").alias("principal"), F.col("target").alias("_policy"))
    attached = managed.join(has, F.col("source") == F.col("_policy")).drop("_policy")
    own = inline.unionByName(attached)
    member = policies.members.where("edge_hint = 'MemberOf'").select(F.col("source").alias("user"), F.col("target").alias("principal"))
    grouped = own.join(member, "principal").withColumn("principal", F.col("user")).drop("user")
    return own.unionByName(grouped).dropDuplicates(["principal", "fact_id", "source", "at"])


def candidate_resources(nodes: DataFrame) -> DataFrame:
    """Each action with the resources that its capability is about: node types and service fit."""
    cfg = capabilities(nodes.sparkSession).withColumn("node_type", F.explode("types")).drop("types")
    held = nodes.where(~blank("arn")).withColumn("of", service_of_resource("node_id", "arn")).join(F.broadcast(cfg), "node_type").where("of = service")
    return held.select("ord", "edge", "action", "kind", "weight", F.col("node_id").alias("res_node"), F.col("arn").alias("res_arn"), F.concat("arn", "suffix").alias("target_arn"))


#: Parts that people are dealt to where a statement is open to everyone, and resources where a statement has a pattern of them.
SALTS = 64


def _on_resources(statements: DataFrame, resources: DataFrame) -> DataFrame:
    """Statements (with ``action``) and the resources of the action that they match."""
    spots = resources.select("action", "target_arn", "res_node", "edge")
    exact = (F.size("not_resources") == 0) & (F.size("resources") > 0) & F.forall("resources", lambda r: glob_class(r) == "exact")
    named = statements.where(exact).withColumn("target_arn", F.explode(F.array_distinct("resources"))).join(spots, ["action", "target_arn"])
    # an action may have any number of resources: they are dealt to SALTS parts, each of which meets all statements of the action
    part = F.pmod(F.xxhash64("target_arn"), F.lit(SALTS))
    dealt = statements.where(~exact).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    loose = dealt.join(spots.withColumn("_part", part), ["action", "_part"]).where(P.statement_resource_match("target_arn"))
    return named.unionByName(loose.select(*named.columns))


def _tri(df: DataFrame) -> DataFrame:
    return df.withColumn("known", P.principal_context("principal")).withColumn("tri", P.eval_conditions("conditions", "known")).drop("known")


def allowed_by(matched: DataFrame) -> DataFrame:
    """``(principal, action, target_arn, solid, labels, facts)`` of matched allow statements with their ``tri``."""
    usable = matched.where("tri < 2")
    solid = F.min("tri") == 0
    labels = F.flatten(F.collect_list(F.when(F.col("tri") == 1, P.condition_labels("conditions"))))
    facts = lambda t: F.collect_set(F.when(F.col("tri") == t, F.col("fact_id")))
    rows = usable.groupBy(*PAIR).agg(solid.alias("solid"), labels.alias("l"), facts(0).alias("f0"), facts(1).alias("f1"))
    return rows.select(*PAIR, "solid", F.when(~F.col("solid"), F.array_sort(F.array_distinct("l"))).otherwise(F.array().cast("array<string>")).alias("labels"), F.array_sort(F.when(F.col("solid"), F.col("f0")).otherwise(F.col("f1"))).alias("facts"))


def _identity_allows(policies: Policies, resources: DataFrame, people: DataFrame) -> DataFrame:
    own = principal_statements(policies).join(people.select("principal"), "principal", "left_semi")
    statements = _matched(own.where(P.allows())).select("principal", *STATEMENT)
    return allowed_by(_tri(_on_resources(statements, resources)))


def _resource_statements(policies: Policies) -> DataFrame:
    rows = policies.of("resource_policy")
    return _matched(rows)


def _prefix(pattern: Column) -> Column:
    """What a pattern starts with before its first wildcard, up to the last border of a segment."""
    return F.regexp_extract(pattern, r"^([^*?]*[:/])", 1)


def _prefixes(subject: Column) -> Column:
    """All that ``_prefix`` may be of a pattern that matches the subject, and the subject itself."""
    parts = F.split(subject, r"(?<=[:/])")
    return F.array_distinct(F.concat(F.array(F.lit(""), subject), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ""))))


def named_people(statements: DataFrame, people: DataFrame) -> DataFrame:
    """Statements with each principal that they name directly (``principal_match_direct``), by joins on equality.

    A pattern meets the principals that share what stands before its wildcard, segment by segment, and is compared with these.
    A statement for everyone meets all of them, dealt to ``SALTS`` parts.
    """
    rows = stored(statements.withColumn("_row", F.monotonically_increasing_id()), "statements")
    everyone = stored(people.select("principal").where("principal is not null").distinct(), "people")
    part = F.pmod(F.xxhash64("principal"), F.lit(SALTS))
    public = rows.where("public").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).join(everyone.withColumn("_part", part), "_part").drop("_part")
    each = rows.where("not public").withColumn("_x", F.explode(F.array_distinct(F.filter("principals", lambda x: ~x.endswith(":root")))))
    keyed = each.withColumn("_key", F.when(glob_class("_x") == "exact", F.col("_x")).otherwise(_prefix(F.col("_x"))))
    met = keyed.join(everyone.withColumn("_key", F.explode(_prefixes(F.col("principal")))), "_key").where((F.col("_x") == F.col("principal")) | glob_match("_x", "principal"))
    columns = ["principal", *statements.columns]
    return public.select(*columns, "_row").unionByName(met.select(*columns, "_row")).dropDuplicates(["_row", "principal"]).select(*columns)


def _resource_allows(policies: Policies, resources: DataFrame, people: DataFrame) -> DataFrame:
    """Direct allows of resource policies; a policy belongs to the arn that it is attached to."""
    rows = _resource_statements(policies).where(P.allows()).select(F.col("source").alias("target_arn"), *STATEMENT)
    at = rows.join(resources.select("action", "target_arn").distinct(), ["action", "target_arn"]).where(P.statement_resource_match("target_arn"))
    return allowed_by(_tri(named_people(at, people)))


def explicit_deny(pairs: DataFrame, policies: Policies) -> DataFrame:
    """``(principal, action, target_arn, hard, labels)`` of pairs that some deny matches: identity, boundary, account, resource."""
    sets = []
    own = principal_statements(policies).where(P.denies())
    bounds = policies.of("permission_boundary").where(P.denies()).withColumn("principal", F.col("source"))
    for rows in (own, bounds):
        sets.append(_matched(rows).select("principal", *STATEMENT).join(pairs.select(*PAIR), ["principal", "action"]))
    scps = _matched(policies.of("scp").where(P.denies())).select(F.col("account").alias("of"), *STATEMENT)
    # one account may have most of the pairs, so the policies go to them, not both to the account
    sets.append(pairs.select(*PAIR, account_of("principal").alias("of")).join(small(stored(scps, "scps")), ["of", "action"]).drop("of"))
    attached = _resource_statements(policies).where(P.denies()).select(F.col("source").alias("target_arn"), *STATEMENT)
    sets.append(attached.join(pairs.select(*PAIR), ["target_arn", "action"]).where(P.principal_match_broad("principal")))
    every = sets[0].select(*PAIR, *[c for c in STATEMENT if c != "action"])
    for s in sets[1:]:
        every = every.unionByName(s.select(*every.columns))
    hit = _tri(every.where(P.statement_resource_match("target_arn"))).where("tri < 2")
    return hit.groupBy(*PAIR).agg((F.min("tri") == 0).alias("hard"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(P.condition_labels("conditions"))))).alias("deny_labels"))


def scp_gate(pairs: DataFrame, policies: Policies) -> DataFrame:
    """Pairs whose account has no service control policy, or one that allows the action."""
    scps = policies.of("scp")
    allowed = small(stored(_matched(scps.where(P.allows())).select(F.col("account").alias("of"), "action").distinct(), "allowed"))
    of = pairs.withColumn("of", account_of("principal"))
    governed = small(stored(scps.select(F.col("account").alias("of")).distinct(), "governed"))
    return of.join(governed, "of", "left_anti").unionByName(of.join(allowed, ["of", "action"], "left_semi"), allowMissingColumns=True).select(*pairs.columns)


def boundary_gate(pairs: DataFrame, policies: Policies) -> DataFrame:
    """Pairs whose principal has no boundary, or one that allows the action on the resource, conditionally perhaps."""
    bounds = policies.of("permission_boundary").withColumn("principal", F.col("source"))
    met = _matched(bounds.where(P.allows())).select("principal", *STATEMENT).join(pairs.select(*PAIR), ["principal", "action"])
    fine = _tri(met.where(P.statement_resource_match("target_arn"))).where("tri < 2").select(*PAIR).distinct()
    free = pairs.join(bounds.select("principal").distinct(), "principal", "left_anti")
    return free.select(*pairs.columns).unionByName(pairs.join(fine, PAIR, "left_semi").select(*pairs.columns))


def _key_principals(grants: DataFrame, people: DataFrame, identity: DataFrame) -> DataFrame:
    """Grants with each principal that they name (``names``) or whose account's root they name (``root``).

    Names and patterns meet principals as in ``named_people``. A root only hands over to what identity policies grant, so it meets
    the pairs of its account, key and action in ``identity`` rather than all principals of the account.
    """
    flags = lambda df, names: df.withColumn("names", F.lit(names)).withColumn("root", F.lit(not names))
    own = grants.columns
    each = grants.withColumn("p", F.explode(F.array_distinct("principals")))
    rooted = F.col("p").endswith(":root") | F.col("p").rlike("^[0-9]{12}$")
    granted = identity.select(*PAIR, account_of("principal").alias("of")).join(people.select("principal"), "principal", "left_semi")
    roots = each.where(rooted).select(*own, account_of("p").alias("of")).distinct().join(granted.distinct(), ["of", "target_arn", "action"])
    return flags(named_people(grants, people), True).unionByName(flags(roots.select("principal", *own), False))


def kms_decision(identity: DataFrame, policies: Policies, resources: DataFrame, people: DataFrame) -> DataFrame:
    """Pairs of ``kms:`` actions: direct grants of the key policy, delegation to IAM, or an unknown key policy."""
    keys = policies.of("resource_policy")
    grants = _matched(keys.where(P.allows() & ~P.has_condition_key("conditions", "kms:viaservice"))).where("action like 'kms:%'")
    grants = grants.select(F.col("source").alias("target_arn"), *STATEMENT).join(resources.select("action", "target_arn").distinct(), ["action", "target_arn"])
    met = _key_principals(grants, people, identity)
    tri = _tri(met)
    by_key = tri.groupBy(*PAIR).agg(
        F.max(F.col("names") & (F.col("tri") == 0)).alias("direct"), F.max(F.col("names") & (F.col("tri") == 1)).alias("maybe"), F.max("root").alias("root"),
        F.array_sort(F.collect_set(F.when(F.col("names") & (F.col("tri") < 2), F.col("fact_id")))).alias("key_facts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("names") & (F.col("tri") == 1), P.condition_labels("conditions")))))).alias("key_labels"),
    )
    known = keys.select(F.col("source").alias("target_arn")).distinct().withColumn("collected", F.lit(True))
    both = identity.where("action like 'kms:%'").join(by_key, PAIR, "full").join(known, "target_arn", "left")
    empty, has = F.array().cast("array<string>"), F.col("solid").isNotNull()
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    case = F.when(yes("direct"), "direct").when(yes("root") & has, "delegated").when(yes("maybe"), "maybe").when(~yes("collected") & has, "unknown")
    rows = both.withColumn("case", case).where("case is not null")
    conditional = F.when(F.col("case") == "direct", F.lit(False)).when(F.col("case") == "delegated", ~F.col("solid")).otherwise(F.lit(True))
    labels = F.when(F.col("case") == "maybe", F.col("key_labels")).when(F.col("case") == "unknown", F.array(F.lit("key_policy_unknown"))).otherwise(empty)
    facts_ = F.when(F.col("case").isin("direct", "maybe"), F.col("key_facts")).otherwise(F.col("facts"))
    return rows.select(*PAIR, F.when(F.col("case").isin("direct", "maybe"), "resource").otherwise("identity").alias("via"), conditional.alias("conditional"), labels.alias("conditions"), facts_.alias("facts"))


def combine_decision(identity: DataFrame, resource: DataFrame) -> DataFrame:
    """Same account (or an unknown one): either side; another account: both. Arrays sorted and distinct."""
    i = identity.select(*PAIR, F.col("solid").alias("i_solid"), F.col("labels").alias("i_labels"), F.col("facts").alias("i_facts"))
    r = resource.select(*PAIR, F.col("solid").alias("r_solid"), F.col("labels").alias("r_labels"), F.col("facts").alias("r_facts"))
    both = i.join(r, PAIR, "full")
    mine, theirs = account_of("principal"), account_of("target_arn")
    same = (mine == "") | (theirs == "") | (mine == theirs)
    via = F.when(F.col("i_solid").isNotNull() & F.col("r_solid").isNotNull(), "identity+resource").when(same & F.col("i_solid").isNotNull(), "identity").when(same & F.col("r_solid").isNotNull(), "resource")
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    conditional = F.coalesce(~F.col("i_solid"), F.lit(False)) | F.coalesce(~F.col("r_solid"), F.lit(False))
    return both.withColumn("via", via).where("via is not null").select(*PAIR, "via", conditional.alias("conditional"), F.array_sort(F.array_union(some("i_labels"), some("r_labels"))).alias("conditions"), F.array_sort(F.array_union(some("i_facts"), some("r_facts"))).alias("facts"))


def aws_permission_edges(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Permission edges of AWS principals: ACTIVE at confidence 1, or CONDITIONAL at one half."""
    people = stored(nodes.where(F.col("node_type").isin(*PRINCIPAL_TYPES) & ~blank("arn")).select(F.col("arn").alias("principal"), F.col("node_id").alias("p_node"), "provider").dropDuplicates(["principal", "p_node"]), "people")
    resources = stored(candidate_resources(nodes), "resources")
    policies = load_policies(facts)
    identity = stored(_identity_allows(policies, resources, people), "identity")
    plain = combine_decision(identity.where("action not like 'kms:%'"), _resource_allows(policies, resources, people).where("action not like 'kms:%'"))
    decided = stored(plain.unionByName(kms_decision(identity, policies, resources, people)), "decided")
    gated = boundary_gate(scp_gate(decided, policies), policies)
    denied = stored(explicit_deny(decided, policies), "denied")
    left = gated.join(denied.where("hard").select(*PAIR), PAIR, "left_anti").join(denied.where("not hard").select(*PAIR, "deny_labels"), PAIR, "left")
    loose = F.col("conditional") | F.col("deny_labels").isNotNull() & ~F.col("action").startswith("kms:")
    conditions = F.when(F.col("action").startswith("kms:"), F.col("conditions")).otherwise(F.array_sort(F.array_union("conditions", F.coalesce("deny_labels", F.array().cast("array<string>")))))
    met = left.withColumn("loose", loose).withColumn("conditions", conditions).join(resources, ["action", "target_arn"]).join(people, "principal").where("p_node != res_node")
    return met.select(
        edge_id("edge", "p_node", "res_node", "res_arn").alias("edge_id"), F.col("edge").alias("type"), F.col("p_node").alias("source"), F.col("res_node").alias("target"), F.col("kind").alias("relationship_kind"), F.lit("explicit").alias("nature"), "provider",
        F.when(F.col("loose"), "CONDITIONAL").otherwise("ACTIVE").alias("state"), F.when(F.col("loose"), 0.5).otherwise(1.0).alias("confidence"), "weight", F.col("res_arn").alias("scope"), F.array("action").alias("permissions"), "conditions", "facts", F.to_json(F.struct("via", "action")).alias("evidence"),
    )


def public_statements(policies: Policies) -> DataFrame:
    """Allow statements of resource policies that name everyone."""
    return policies.of("resource_policy").where(P.allows() & F.col("public"))
