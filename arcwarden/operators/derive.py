"""Composition of edges to a fixpoint with a configurable rule table.

Rounds are semi-naive: only edges that are new or better than in the last round meet the others. Both edges of a rule are
first matched with the broadcast rule table, so each geometry is one equi-join on (rule, node). A derived edge is better by less
weight, then by state; ties go to the smaller rule and parents, so results don't depend on the order of rows.

Known edges are a store of runs that only grows: a round writes the edges it found or bettered, and the numbers of those that
these replace. Beyond a few, runs of like size are merged, so that there are few of them and every row is written a logarithm of times.
Offers are narrow: they meet the narrow columns of what is known, and only those that win fetch permissions, conditions and
history from their parents. The loop ends when a round brings nothing better, however many rounds that takes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.catalog import CHAIN, CONTAINER_TYPES, IDENTITY_TYPES, PROMOTIONS, RULES, SAME_SOURCE, SAME_TARGET
from arcwarden.functions.scalars import edge_id, node_account, text
from arcwarden.tables import BROADCAST_ROWS, config_frame, is_empty, small, stored

KEY = ["type", "source", "target", "scope"]
COLUMNS = ["edge_id", *KEY, "relationship_kind", "nature", "provider", "state", "confidence", "weight", "permissions", "conditions", "derived_from", "rule_id"]


@dataclass(frozen=True)
class DeriveConfig:
    rules: tuple = RULES
    promotions: tuple = PROMOTIONS
    takeovers: bool = True


def state_rank(state: Column) -> Column:
    return F.when(state == "ACTIVE", F.lit(2)).when(state == "CONDITIONAL", F.lit(1)).otherwise(F.lit(0))


def weakest(a: Column, b: Column) -> Column:
    return F.when((a == "BLOCKED") | (b == "BLOCKED"), F.lit("BLOCKED")).when((a == "ACTIVE") & (b == "ACTIVE"), F.lit("ACTIVE")).otherwise(F.lit("CONDITIONAL"))


def normalized(edges: DataFrame) -> DataFrame:
    """``edges`` with all columns of the loop; absent ones get their defaults."""
    empty = F.array().cast("array<string>")
    defaults = {"scope": F.lit(""), "relationship_kind": F.lit(""), "nature": F.lit("explicit"), "provider": F.lit(""), "state": F.lit("ACTIVE"), "confidence": F.lit(1.0), "weight": F.lit(1.0), "permissions": empty, "conditions": empty, "derived_from": empty, "rule_id": F.lit("")}
    full = edges.withColumns({c: F.coalesce(F.col(c), d) if c in edges.columns else d for c, d in defaults.items()})
    if "edge_id" not in edges.columns:
        full = full.withColumn("edge_id", edge_id(*KEY))
    return full.select(*COLUMNS)


def _side(e: DataFrame, prefix: str) -> DataFrame:
    return e.select(*[F.col(c).alias(f"{prefix}_{c}") for c in e.columns])


def _from(ids: Column, own: Column) -> Column:
    return F.when(F.size(ids) > 0, ids).otherwise(F.array(own))


def _composed(more: dict[str, Column]) -> list[Column]:
    """The columns of the edge that a rule makes of a pair ``a_*``, ``b_*``, and ``more`` of them."""
    own = {
        "type": F.coalesce(F.col("emit"), F.col("b_type")), "source": F.col("a_source"), "target": F.when(F.col("geometry") == SAME_TARGET, F.col("b_source")).otherwise(F.col("b_target")),
        "scope": F.col("b_scope"), "relationship_kind": F.col("b_relationship_kind"), "nature": F.lit("derived"), "provider": F.col("b_provider"), "state": weakest(F.col("a_state"), F.col("b_state")),
        "confidence": F.least("a_confidence", "b_confidence") * F.col("prior"), "weight": F.col("a_weight") + F.col("b_weight") + F.col("add"), "rule_id": F.col("rule_id"),
    }
    return [c.alias(n) for n, c in {**own, **more}.items()]


def compose(pairs: DataFrame) -> DataFrame:
    """The edge that a rule makes of each pair ``a_*``, ``b_*``; needs the rule's columns too."""
    history = F.concat(_from(F.col("a_derived_from"), F.col("a_edge_id")), _from(F.col("b_derived_from"), F.col("b_edge_id")))
    wide = {"permissions": F.col("b_permissions"), "conditions": F.array_union("a_conditions", "b_conditions"), "derived_from": history}
    return pairs.select(*_composed(wide)).withColumn("edge_id", edge_id(*KEY)).select(*COLUMNS)


def rule_pairs(left: DataFrame, right: DataFrame, config: DeriveConfig, pivots: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs of edges that some rule joins, as ``a_*`` and ``b_*``, with the rule's columns.

    Where most of a large ``right`` meets nothing, ``pivots`` makes of the nodes ``at`` of the left those that the right is cut to first.
    """
    spark = left.sparkSession
    firsts = config_frame(spark, [(r, g, t, e, p, w) for r, g, first, _, e, p, w in config.rules for t in first], "rule_id string, geometry string, a_type string, emit string, prior double, add double")
    seconds = config_frame(spark, [(r, g, t) for r, g, _, second, *_ in config.rules for t in second], "rule string, geo string, b_type string")
    a = _side(left.drop("rule_id"), "a").join(F.broadcast(firsts), "a_type")
    a = a.withColumn("at", F.when(F.col("geometry") == SAME_SOURCE, F.col("a_source")).otherwise(F.col("a_target")))
    b = _side(right.drop("rule_id"), "b").join(F.broadcast(seconds), "b_type")
    b = b.withColumn("at", F.when(F.col("geo") == SAME_TARGET, F.col("b_target")).otherwise(F.col("b_source")))
    if pivots is not None:
        b = b.join(pivots(a.select("at")), "at", "left_semi")
    # nodes of one kind begin alike, so rows are sorted by a number
    a, b = a.withColumn("_h", F.xxhash64("at", "rule_id")), b.withColumn("_h", F.xxhash64("at", "rule"))
    met = (a["_h"] == b["_h"]) & (a["at"] == b["at"]) & (F.col("rule_id") == F.col("rule"))
    return a.join(b, met & (F.col("a_edge_id") != F.col("b_edge_id"))).drop("at", "rule", "geo", "_h")


def join_rules(left: DataFrame, right: DataFrame, config: DeriveConfig = DeriveConfig()) -> DataFrame:
    """All two-edge rules with their first edge from ``left`` and their second from ``right``."""
    return compose(rule_pairs(left, right, config))


def rule_groups(left: DataFrame, right: DataFrame, config: DeriveConfig = DeriveConfig()) -> DataFrame:
    """What ``join_rules`` makes, by rule, type, source, target and state: number ``n``, least weight, most confidence.

    Edges that differ in type alone go through join and grouping as one row with a list of types, written out last: no join,
    grouping or shuffle meets as many rows as come out. Edges are told apart by their key.
    """
    spark, key = left.sparkSession, ["source", "target", "scope", "state", "weight", "confidence"]
    firsts = config_frame(spark, [(r, g, t, e, p, w) for r, g, first, _, e, p, w in config.rules for t in first], "rule_id string, geometry string, type string, emit string, prior double, add double")
    seconds = config_frame(spark, [(r, g, t) for r, g, _, second, *_ in config.rules for t in second], "rule_id string, geometry string, type string")

    def side(edges: DataFrame, cfg: DataFrame, prefix: str, away: str, by_target: Column) -> DataFrame:
        rule = [c for c in cfg.columns if c != "type"]
        alike = edges.select("type", *key).join(F.broadcast(cfg), "type").groupBy(*rule, *key).agg(F.sort_array(F.collect_list("type")).alias("types"))
        at = F.when(by_target, F.col("target")).otherwise(F.col("source"))
        return alike.select(*[c for c in rule if c not in away], *[F.col(c).alias(f"{prefix}_{c}") for c in (*key, "types")], at.alias("at")).withColumn("_h", F.xxhash64("at", "rule_id"))

    a = side(left, firsts, "a", "", F.col("geometry") != SAME_SOURCE)
    b = side(right, seconds, "b", "geometry", F.col("geometry") == SAME_TARGET)
    pairs = a.join(b, ["_h", "at", "rule_id"])
    # an edge doesn't meet itself
    same = (F.col("a_source") == F.col("b_source")) & (F.col("a_target") == F.col("b_target")) & (F.col("a_scope") == F.col("b_scope"))
    part = lambda types, n: F.struct(types.alias("types"), n.cast("long").alias("n"))
    others = F.transform("b_types", lambda t: part(F.array(t), F.size(F.filter("a_types", lambda x: x != t))))
    parts = pairs.withColumn("p", F.explode(F.when(same, others).otherwise(F.array(part(F.col("b_types"), F.size("a_types")))))).where("p.n > 0")
    made = parts.select(
        "rule_id", F.col("a_source").alias("source"), F.when(F.col("geometry") == SAME_TARGET, F.col("b_source")).otherwise(F.col("b_target")).alias("target"), weakest(F.col("a_state"), F.col("b_state")).alias("state"),
        F.when(F.col("emit").isNull(), F.col("p.types")).otherwise(F.array("emit")).alias("types"), (F.col("p.n") * F.when(F.col("emit").isNull(), 1).otherwise(F.size("p.types"))).alias("n"),
        (F.col("a_weight") + F.col("b_weight") + F.col("add")).alias("weight"), (F.least("a_confidence", "b_confidence") * F.col("prior")).alias("confidence"),
    )
    by = ["rule_id", "source", "target", "state"]
    # both groupings stay where this deals the rows
    once = made.repartition(*by).groupBy(*by, "types").agg(F.sum("n").alias("n"), F.min("weight").alias("weight"), F.max("confidence").alias("confidence"))
    held = once.groupBy(*by).agg(F.collect_list(F.struct("types", "n", "weight", "confidence")).alias("e"))
    one = lambda t, n, weight, confidence: F.struct(t.alias("type"), n.alias("n"), weight.alias("weight"), confidence.alias("confidence"))
    times = lambda e, t: F.size(F.filter(e["types"], lambda x: x == t))
    first = F.col("e")[0]

    def merged(t: Column) -> Column:
        own = F.filter("e", lambda e: F.array_contains(e["types"], t))
        n = F.aggregate(own, F.lit(0).cast("long"), lambda s, e: s + e["n"] * times(e, t))
        return one(t, n, F.array_min(F.transform(own, lambda e: e["weight"])), F.array_max(F.transform(own, lambda e: e["confidence"])))

    plain = (F.size("e") == 1) & (F.size(first["types"]) == F.size(F.array_distinct(first["types"])))
    alone = F.transform(first["types"], lambda t: one(t, first["n"], first["weight"], first["confidence"]))
    several = F.transform(F.array_distinct(F.flatten(F.transform("e", lambda e: e["types"]))), merged)
    return held.select(*by, F.explode(F.when(plain, alone).otherwise(several)).alias("m")).select("rule_id", "m.type", "source", "target", "state", "m.n", "m.weight", "m.confidence")


def promotions(edges: DataFrame, nodes: DataFrame, config: DeriveConfig = DeriveConfig()) -> DataFrame:
    """One-edge promotions; ``nodes(node_id, node_type)`` gives the targets' types."""
    spark = edges.sparkSession
    cfg = config_frame(spark, [(p, t, e, list(types) if types else None, prior, kind) for p, match, e, types, prior, kind in config.promotions for t in match], "promotion string, type string, emit string, types array<string>, prior double, kind string")
    typed = edges.drop("rule_id").join(F.broadcast(cfg), "type").join(nodes.select(F.col("node_id").alias("target"), "node_type"), "target", "left")
    fits = typed.where(F.col("types").isNull() | F.array_contains("types", F.coalesce("node_type", F.lit(""))))
    made = fits.select(
        F.col("emit").alias("type"), "source", "target", "scope", F.col("kind").alias("relationship_kind"), F.lit("derived").alias("nature"), "provider", "state",
        (F.col("confidence") * F.col("prior")).alias("confidence"), "weight", "permissions", "conditions", _from(F.col("derived_from"), F.col("edge_id")).alias("derived_from"), F.col("promotion").alias("rule_id"),
    )
    return made.withColumn("edge_id", edge_id(*KEY)).select(*COLUMNS)


def _taken(pairs: DataFrame, type_: str, kind: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    made = pairs.select(
        F.lit(type_).alias("type"), "source", F.col("node_id").alias("target"), F.lit("").alias("scope"), F.lit(kind).alias("relationship_kind"), F.lit("derived").alias("nature"), "provider", "state",
        (F.col("confidence") * 0.85).alias("confidence"), (F.col("weight") + 2.0).alias("weight"), empty.alias("permissions"), empty.alias("conditions"), _from(F.col("derived_from"), F.col("edge_id")).alias("derived_from"), F.lit("project-takeover").alias("rule_id"),
    )
    return made.withColumn("edge_id", edge_id(*KEY)).select(*COLUMNS)


_CONTROL = "CanControl", "CONTROL"
_ESCALATE = "CanEscalateTo", "DERIVED_ATTACK_PATH"


def _controllers(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    over = nodes.where(F.col("node_type").isin(*types)).select(F.col("node_id").alias("target"))
    return edges.where(F.col("type").isin("CanControl", "CanGrantPermission")).drop("rule_id").join(over, "target", "left_semi")


def account_takeover(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Who controls an account's container controls every node of the account, and escalates to its identities."""
    held = _controllers(edges, nodes, CONTAINER_TYPES).withColumn("account", node_account("target")).where("account != ''")
    inside = nodes.where("node_type is null or node_type != 'Project'").select("node_id", "node_type", node_account("node_id").alias("account"))
    pairs = held.join(inside, "account").where(F.col("node_id") != F.col("source"))
    return _taken(pairs, *_CONTROL).unionByName(_taken(pairs.where(F.col("node_type").isin(*IDENTITY_TYPES)), *_ESCALATE))


#: Parts that nodes are dealt to where controllers of a tenant meet all of them.
SALTS = 64


def tenant_takeover(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Who controls a tenant controls its subscriptions, and escalates to every identity.

    Meets all nodes of these two kinds, dealt to ``SALTS`` parts, each of which meets all controllers by equality.
    """
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    held = _controllers(edges, nodes, ("Tenant",)).withColumn("_part", parts)
    reach = nodes.where(F.col("node_type").isin("Subscription", *IDENTITY_TYPES)).select("node_id", "node_type", F.pmod(F.xxhash64("node_id"), F.lit(SALTS)).alias("_part"))
    pairs = reach.join(held, "_part").where(F.col("node_id") != F.col("source")).drop("_part")
    return _taken(pairs.where("node_type = 'Subscription'"), *_CONTROL).unionByName(_taken(pairs.where("node_type != 'Subscription'"), *_ESCALATE))


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge of each key: explicit before derived, then least weight, best state, smallest rule and history."""
    order = F.struct((F.col("nature") == "derived").alias("d"), "weight", (-state_rank(F.col("state"))).alias("r"), "rule_id", "derived_from", "edge_id")
    rest = [c for c in COLUMNS if c not in KEY]
    return edges.groupBy(*KEY).agg(F.min_by(F.struct(*rest), order).alias("e")).select(*KEY, "e.*").select(*COLUMNS)


#: What offers know of their edges; ``kid`` is the key's hash.
NARROW = ["kid", "edge_id", *KEY, "relationship_kind", "nature", "provider", "state", "confidence", "weight"]
#: How an edge gets its permissions and conditions from its parents.
RULE, PROMOTION, TAKEOVER = "rule", "promotion", "takeover"


def _rating() -> Column:
    return F.struct((F.col("nature") == "derived").alias("d"), "weight", (-state_rank(F.col("state"))).alias("r"))


#: Runs that are kept as they are.
RUNS = 8


@dataclass
class EdgeStore:
    """Edges by runs, with the ``round`` each row was written in, and rows that later ones replaced, as ``gone(kid, round)``."""

    runs: list[tuple[DataFrame, int]] = field(default_factory=list)
    gone: list[tuple[DataFrame, int]] = field(default_factory=list)

    def rows(self, columns: list[str] | None = None) -> DataFrame | None:
        """The current rows, with ``round``; only ``columns`` of them are read."""
        if not self.runs:
            return None
        every = None
        for run, _ in self.runs:
            own = run if columns is None else run.select(*columns, "round")
            every = own if every is None else every.unionByName(own)
        return self._without_gone(every)

    def _without_gone(self, rows: DataFrame) -> DataFrame:
        for g, n in self.gone:
            rows = rows.join(small(g, n), ["kid", "round"], "left_anti")
        return rows

    def add(self, run: DataFrame, n: int) -> None:
        """One more run (stored); while there are more than ``RUNS`` and the run before isn't larger, both become one."""
        self.runs.append((run, n))
        while len(self.runs) > RUNS and self.runs[-2][1] <= self.runs[-1][1]:
            (a, m), (b, n) = self.runs[-2:]
            self.runs[-2:] = [(stored(self._without_gone(a.unionByName(b)), "edges"), m + n)]

    def drop(self, gone: DataFrame, n: int) -> None:
        """Rows that don't count any longer (a stored table)."""
        if not n:
            return
        self.gone.append((gone, n))
        if len(self.gone) > 4:
            every, n = self.gone[0]
            for g, m in self.gone[1:]:
                every, n = every.unionByName(g), n + m
            self.gone = [(stored(every, "gone"), n)]


def _pivots(ats: DataFrame) -> DataFrame:
    found = stored(ats.distinct(), "pivots")
    return small(found)


def _rule_offers(left: DataFrame, right: DataFrame, config: DeriveConfig, large: bool) -> DataFrame:
    parents = {"a_kid": F.col("a_kid"), "b_kid": F.col("b_kid"), "how": F.lit(RULE)}
    return rule_pairs(left, right, config, _pivots if large else None).select(*_composed(parents))


def _single_offers(made: DataFrame, how: str) -> DataFrame:
    """Offers of promotions and takeovers: their history is their parent's, by its ``kid``."""
    return made.select(*KEY, "relationship_kind", "nature", "provider", "state", "confidence", "weight", "rule_id", F.element_at("derived_from", 1).alias("a_kid"), F.lit(None).cast("string").alias("b_kid"), F.lit(how).alias("how"))


def _widened(won: DataFrame, n: int, every: DataFrame) -> DataFrame:
    """The ``n`` offers that won with permissions, conditions and history, from their parents among ``every``."""
    held = every.select("kid", "edge_id", "permissions", "conditions", "derived_from")
    for side in ("a", "b"):
        # no more parents than offers, so both are small if the offers are
        parents = held.join(small(won.select(F.col(f"{side}_kid").alias("kid")), n), "kid", "left_semi")
        won = won.join(small(_side(parents, side), n), f"{side}_kid", "left")
    empty = F.array().cast("array<string>")
    history = F.concat(_from(F.col("a_derived_from"), F.col("a_edge_id")), F.when(F.col("b_kid").isNotNull(), _from(F.col("b_derived_from"), F.col("b_edge_id"))).otherwise(empty))
    by = lambda rule, promotion: F.when(F.col("how") == RULE, rule).when(F.col("how") == PROMOTION, promotion).otherwise(empty)
    wide = {"permissions": by(F.col("b_permissions"), F.col("a_permissions")), "conditions": by(F.array_union("a_conditions", "b_conditions"), F.col("a_conditions")), "derived_from": history}
    return won.withColumns(wide).withColumn("edge_id", F.col("kid")).select("kid", *COLUMNS)


def _firing(config: DeriveConfig, left: set[str], right: set[str]) -> DeriveConfig | None:
    """``config`` with the rules that edges of the types ``left`` and ``right`` may fire; None if there is none."""
    rules = tuple((r, g, a, b, *rest) for r, g, first, second, *rest in config.rules if (a := tuple(t for t in first if t in left)) and (b := tuple(t for t in second if t in right)))
    return replace(config, rules=rules) if rules else None


def _offers(new: DataFrame, old: DataFrame | None, types: DataFrame, kinds: set[str], before: set[str], special: bool, large: bool, config: DeriveConfig) -> DataFrame | None:
    """What edges that are ``new`` (of types ``kinds``) bring with one another and with ``old`` ones (of types ``before``).

    Only what some rule, promotion or takeover may make of these types is read at all; None if that is nothing. Where new edges
    are many (``large``), those that no old one meets don't move.
    """
    parts = []
    if firing := _firing(config, kinds, kinds | before):
        narrow = new if old is None else old.unionByName(new)
        parts.append(_rule_offers(new.drop("round"), narrow.drop("round"), firing, False))
    if old is not None and (firing := _firing(config, before, kinds)):
        parts.append(_rule_offers(old.drop("round"), new.drop("round"), firing, large))
    promoted = {t for _, match, *_ in config.promotions for t in match} & kinds
    taking = special and kinds & {"CanControl", "CanGrantPermission"}
    if promoted or taking:
        # a parent stands for its history, and is found again by its kid
        single = new.drop("edge_id").withColumnRenamed("kid", "edge_id").withColumns({c: F.array().cast("array<string>") for c in ("permissions", "conditions", "derived_from")}).withColumn("rule_id", F.lit("")).select(*COLUMNS)
        if promoted:
            parts.append(_single_offers(promotions(single, types, config), PROMOTION))
        if taking:
            parts.append(_single_offers(account_takeover(single, types).unionByName(tenant_takeover(single, types)), TAKEOVER))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _kinds(config: DeriveConfig) -> Column:
    """Aggregate: the types of edges that rules, promotions or takeovers look at."""
    looked = {t for _, _, first, second, *_ in config.rules for t in (*first, *second)} | {t for _, match, *_ in config.promotions for t in match} | {"CanControl", "CanGrantPermission"}
    return F.collect_set(F.when(F.col("type").isin(*sorted(looked)), F.col("type")))


def fixpoint(edges: DataFrame, nodes: DataFrame, config: DeriveConfig = DeriveConfig(), history: bool = True) -> DataFrame:
    """The derived edges of ``edges`` under the rules, promotions and takeovers, with all columns of the loop.

    A round makes offers from what the last one changed, keeps the best of each key, and those of them that are new or better
    than what is known. Where only chains fire and no derived edge is the first of one, the rounds run over the edges of pivots
    (nodes that first edges lead to), and edges of all other nodes are made last, in one step. Weights below 0 are an error, as the loop might not end. Without ``history`` the columns ``permissions``,
    ``conditions``, ``derived_from`` and ``rule_id`` are left out; no edge depends on them, so the others are the same.
    """
    columns = COLUMNS if history else NARROW[1:]
    types = stored(nodes.select("node_id", "node_type").dropDuplicates(["node_id"]), "types")
    special = config.takeovers and not is_empty(types.where(F.col("node_type").isin(*CONTAINER_TYPES, "Tenant")))
    best = best_edges(normalized(edges)).withColumn("kid", edge_id(*KEY)).select("kid", *columns)
    given = stored(best.withColumn("round", F.lit(0)), "edges")
    n, least, kinds = given.agg(F.count("*"), F.min("weight"), _kinds(config)).first()
    if least is not None and least < 0:
        raise ValueError("edges must not have weights below 0")
    if not _chains(config, set(kinds), special):
        return _closed(given, n, set(kinds), types, special, config, history).where("nature = 'derived'").select(*columns)
    firing = _firing(config, set(kinds), set(kinds))
    if firing is None:
        return given.where("nature = 'derived'").select(*columns)
    first = given.where(F.col("type").isin(*sorted({t for _, _, types_, *_ in firing.rules for t in types_})))
    pivots = stored(first.select(F.col("target").alias("source")).distinct(), "pivots")
    at = small(pivots)
    core = stored(given.join(at, "source", "left_semi"), "edges")
    known = stored(_closed(core, core.count(), set(kinds), types, special, config, history).drop("round"), "edges")
    # what stands before all pivots takes the best of what these hold, once
    outer = first.join(at, "source", "left_anti")
    picked = _picked(_rule_offers(outer.select(*NARROW), known.select(*NARROW), firing, False))
    won = picked.join(given.select("kid"), "kid", "left_anti")
    if history:
        won = stored(won, "won")
        made = _widened(won, won.count(), known.unionByName(outer.drop("round")))
    else:
        made = won.withColumn("edge_id", F.col("kid"))
    own = given.join(at, "source", "left_anti").select(*columns)
    return known.select(*columns).unionByName(own).where("nature = 'derived'").unionByName(made.select(*columns))


def _chains(config: DeriveConfig, kinds: set[str], special: bool) -> bool:
    """Whether of edges of the types ``kinds`` only ``CHAIN`` rules make others, none of which is the first edge of a rule.

    Then the nodes that first edges lead to, the pivots, are known beforehand, and edges from other nodes are nobody's second.
    """
    found, made = set(kinds), set()
    while True:
        firing = _firing(config, found, found)
        rules = firing.rules if firing else ()
        if any(geometry != CHAIN for _, geometry, *_ in rules):
            return False
        made |= {t for _, _, _, second, emit, *_ in rules for t in ((emit,) if emit else second)}
        if made <= found:
            break
        found |= made
    single = {t for _, match, *_ in config.promotions for t in match} | ({"CanControl", "CanGrantPermission"} if special else set())
    return not found & single and not made & {t for _, _, first, *_ in config.rules for t in first}


def _picked(offers: DataFrame) -> DataFrame:
    """The best offer of each key; grouped by the key's hash first, as keys begin alike and groups are sorted."""
    key = ["kid", *KEY]
    rest = [c for c in offers.columns if c not in KEY]
    order = F.struct("weight", (-state_rank(F.col("state"))).alias("r"), "rule_id", "a_kid", "b_kid")
    return offers.withColumn("kid", edge_id(*KEY)).groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("o")).select(*key, "o.*")


def _closed(given: DataFrame, n: int, kinds: set[str], types: DataFrame, special: bool, config: DeriveConfig, history: bool) -> DataFrame:
    """The ``n`` stored edges ``given``, of types ``kinds``, and all that they bring, round by round."""
    fresh, store, step, before = given, EdgeStore(), 0, set()
    while n:
        step += 1
        old = store.rows(NARROW)
        new = fresh.select(*NARROW, "round")
        offers = _offers(new, old, types, set(kinds), before, special, n > BROADCAST_ROWS, config)
        if offers is None:
            store.add(fresh, n)
            break
        picked = stored(_picked(offers).withColumn("rating", _rating()), "offers")
        offered = picked.count()
        # a key has one current row, so no more of them meet than were offered
        narrow = new if old is None else old.unionByName(new)
        met = narrow.select("kid", _rating().alias("held"), F.col("round").alias("held_round"))
        if offered <= BROADCAST_ROWS:
            met = met.join(F.broadcast(picked.select("kid")), "kid", "left_semi")
        won = stored(picked.join(small(met, offered), "kid", "left").where("held is null or rating < held").drop("rating", "held"), "won")
        before |= set(kinds)
        n_won, n_gone, kinds = won.agg(F.count("*"), F.count("held_round"), _kinds(config)).first()
        if not n_won:
            following = None
        elif history:
            every = fresh if old is None else store.rows().unionByName(fresh)
            following = stored(_widened(won, n_won, every).withColumn("round", F.lit(step)), "edges")
        else:
            following = won.withColumn("edge_id", F.col("kid")).select(*NARROW).withColumn("round", F.lit(step))
        store.drop(won.where("held_round is not null").select("kid", F.col("held_round").alias("round")), n_gone)
        store.add(fresh, n)
        fresh, n = following, n_won
    known = store.rows()
    return given if known is None else known


def derived_chain(derived: DataFrame, edges: DataFrame) -> DataFrame:
    """``(edge_id, chain)``: what each history entry says, in order; the entry itself where it names no edge."""
    said = edges.select(F.col("edge_id").alias("part"), F.concat_ws(" ", "source", "type", "target").alias("says"))
    parts = derived.select("edge_id", F.posexplode("derived_from").alias("at", "part"))
    named = parts.join(said, "part", "left").select("edge_id", F.struct("at", F.coalesce("says", text("part")).alias("says")).alias("p"))
    return named.groupBy("edge_id").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["says"]).alias("chain"))
