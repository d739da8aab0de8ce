"""Closure and walks on hand-made graphs with cycles, ties and better ways found late, against plain versions."""

import numpy as np
import pytest
from helpers import edges, nodes
from pyspark.sql import functions as F

from arcwarden.operators import condense
from arcwarden.operators import derive as D
from arcwarden.operators import explore as X
from arcwarden.operators import traverse as T


def closure(rows, rounds=50):
    """Best weight of every edge under the rule of assuming and reading, by repetition."""
    best = {(t, s, d): w for t, s, d, w in rows}
    given = dict(best)
    for _ in range(rounds):
        for (t1, a, b), w in list(best.items()):
            for (t2, c, e), v in list(best.items()):
                if t1 == "CanAssume" and b == c and t2 == "CanReadData" and (t1, a, b) != (t2, c, e):
                    key = (t2, a, e)
                    if key not in given and w + v + 1 < best.get(key, 1e9):
                        best[key] = w + v + 1
    return {k: w for k, w in best.items() if k not in given}


def test_fixpoint_with_cycles_and_late_shortcuts(spark):
    rows = [("CanAssume", "a", "b", 1.0), ("CanAssume", "b", "c", 1.0), ("CanAssume", "c", "a", 1.0), ("CanAssume", "a", "d", 9.0), ("CanReadData", "d", "x", 1.0), ("CanAssume", "c", "e", 1.0), ("CanAssume", "e", "d", 1.0), ("CanReadData", "b", "y", 2.0), ("CanReadData", "a", "y", 7.0)]
    given = edges(spark, *[(t, s, d, "ACTIVE", w) for t, s, d, w in rows])
    people = nodes(spark, *[(n, "Role") for n in "abcde"], ("x", "Secret"), ("y", "Secret"))
    found = {(r["type"], r["source"], r["target"]): r["weight"] for r in D.fixpoint(given, people).collect()}
    assert found == closure(rows)
    with pytest.raises(ValueError):
        D.fixpoint(given.withColumn("weight", F.lit(-1.0)), people)


def test_fixpoint_keeps_fields_of_the_best_way(spark):
    """Conditions, permissions and history are those of the parents that won, also where a better way came late."""
    given = edges(spark, ("CanAssume", "a", "d", "ACTIVE", 9.0), ("CanAssume", "a", "b", "CONDITIONAL", 1.0), ("CanAssume", "b", "c", "ACTIVE", 1.0), ("CanAssume", "c", "d", "ACTIVE", 1.0), ("CanReadData", "d", "x", "ACTIVE", 1.0))
    given = given.withColumns({"edge_id": F.concat("source", F.lit(">"), "target"), "conditions": F.when(F.col("state") == "CONDITIONAL", F.array(F.lit("c1"))), "permissions": F.when(F.col("type") == "CanReadData", F.array(F.lit("p1")))})
    found = {(r["source"], r["target"]): r for r in D.fixpoint(given, nodes(spark, ("x", "Secret"))).collect() if r["type"] == "CanReadData"}
    assert found.keys() == {("a", "x"), ("b", "x"), ("c", "x")}
    best = found["a", "x"]
    assert (best["weight"], best["state"], best["conditions"], best["permissions"], best["derived_from"]) == (7.0, "CONDITIONAL", ["c1"], ["p1"], ["a>b", "b>c", "c>d", "d>x"])


def test_fixpoint_has_no_limit_of_rounds(spark):
    """A chain that takes 24 rounds; runs are merged as they grow."""
    n = 24
    given = edges(spark, *[("CanAssume", f"n{k:03d}", f"n{k + 1:03d}") for k in range(n)], ("CanReadData", f"n{n:03d}", "x"))
    found = {r["source"]: r["weight"] for r in D.fixpoint(given, nodes(spark, ("x", "Secret"))).where("type = 'CanReadData'").collect()}
    assert found == {f"n{k:03d}": 1.0 + 2.0 * (n - k) for k in range(n)}


def test_walks_with_cycles(spark):
    given = edges(spark, ("T", "a", "b", "ACTIVE", 5.0), ("T", "a", "c", "ACTIVE", 1.0), ("T", "c", "b", "ACTIVE", 1.0), ("T", "b", "a", "ACTIVE", 1.0), ("T", "b", "d", "CONDITIONAL", 1.0)).withColumn("edge_id", D.edge_id("type", "source", "target", "state"))
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    assert {r["node"] for r in T.reaches(given, one("a")).collect()} == {"b", "c", "d"} and {r["node"] for r in T.reached_by(given, one("d")).collect()} == {"a", "b", "c"}
    way = T.shortest_path(given, one("a"), one("d")).first()
    assert (way["cost"], way["hops"], len(way["edge_ids"])) == (3.0, 3, 3)
    near = T.shortest_path(given, one("a"), one("d"), 2).first()
    assert (near["cost"], near["hops"]) == (6.0, 2) and T.shortest_path(given, one("d"), one("a")).count() == 0
    assert {(r["node"], r["depth"]) for r in T.bfs_depth(given, one("a")).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert T.traversable_edges(given, conditional=False, attack_only=False).count() == 4


def random_graph(spark, rng, n, m):
    rows = [("T", f"n{a:02d}", f"n{b:02d}", "ACTIVE", float(w)) for a, b, w in zip(rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(1, 9, m), strict=True)]
    return rows, edges(spark, *rows).withColumn("edge_id", F.concat(F.lit("e"), F.monotonically_increasing_id()))


def reach(rows, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for _, s, d, *_ in rows:
            if s == at and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


@pytest.mark.parametrize(("n", "m"), [(12, 10), (12, 18), (20, 60), (30, 33)])
def test_components_and_reach_counts(spark, n, m):
    rows, given = random_graph(spark, np.random.default_rng(n * m), n, m)
    all_nodes = {x for r in rows for x in r[1:3]}
    ahead = {x: reach(rows, x) for x in all_nodes}
    want = {x: max(y for y in ahead[x] if x in ahead[y]) for x in all_nodes if any(x in ahead[y] for y in ahead[x] - {x})}
    parts = condense.strong_components(given)
    assert {r["node"]: r["component"] for r in parts.collect()} == want
    names = {x: want.get(x, x) for x in all_nodes}
    assert {tuple(r) for r in condense.condensed(given, parts).collect()} == {(names[r[1]], names[r[2]]) for r in rows if names[r[1]] != names[r[2]]}
    starts, goals = sorted(all_nodes)[::2] + ["alone"], sorted(all_nodes)[::3]
    one = lambda names: spark.createDataFrame([(x,) for x in names], "node string")
    got = {r["node"]: (r["reaches"], r["goals"]) for r in X.reach_counts(given, one(starts), one(goals)).collect()}
    assert got == {x: (len(r), len(r & set(goals))) for x in starts for r in [ahead.get(x, {x})]}
    assert condense.strong_components(given.where("false")).count() == 0


@pytest.mark.parametrize("hops", [None, 1, 3])
def test_nearest_target(spark, hops):
    rows, given = random_graph(spark, np.random.default_rng(7), 20, 34)
    targets = ["n01", "n05", "n11"]
    best = {t: (0.0, t) for t in targets}
    for _ in range(hops or 50):
        old = dict(best)
        for _, s, d, _, w in rows:
            if d in old and (s not in best or (old[d][0] + w, old[d][1]) < best[s]):
                best[s] = (old[d][0] + w, old[d][1])
    found = T.nearest_target(given, spark.createDataFrame([(t,) for t in targets], "node string"), hops).collect()
    assert {r["node"]: (r["cost"], r["target"]) for r in found} == best and all((r["hops"] == 0) == (r["node"] in targets and r["cost"] == 0) for r in found)


def test_rounds_run_over_pivots_only(spark, monkeypatch):
    """Leaves that assume pivots get their edges in one step, the same as round by round, with and without history."""
    chain = [("CanAssume", f"aws|1|t|p{k}", f"aws|1|t|p{k // 2}", "ACTIVE") for k in range(1, 8)] + [("CanAssume", "aws|1|t|p0", "aws|1|t|p3", "CONDITIONAL")]
    reads = [("CanReadData", f"aws|1|t|p{k}", f"aws|1|t|d{k % 5}", "ACTIVE", 2.0) for k in range(0, 8, 3)]
    leaves = [("CanAssume", f"aws|1|t|leaf{k}", f"aws|1|t|p{(k * m) % 8}", state) for k in range(40) for m, state in ((1, "ACTIVE"), (7, "CONDITIONAL"))] + [("CanReadData", "aws|1|t|leaf1", "aws|1|t|d0", "CONDITIONAL", 9.0)]
    graph, none = edges(spark, *chain, *reads, *leaves), nodes(spark, ("aws|1|t|p0", "Role"))
    assert D._chains(D.DeriveConfig(), {"CanAssume", "CanReadData"}, False) and not D._chains(D.DeriveConfig(), {"CanAssume", "CanImpersonate"}, False)
    seen, closed = [], D._closed
    monkeypatch.setattr(D, "_closed", lambda given, n, *rest: seen.append(n) or closed(given, n, *rest))
    fast = D.fixpoint(graph, none)
    assert seen == [len(chain) + len(reads)]
    monkeypatch.setattr(D, "_chains", lambda *_: False)
    slow = {r["edge_id"]: r.asDict() for r in D.fixpoint(graph, none).collect()}
    assert {r["edge_id"]: r.asDict() for r in fast.collect()} == slow and len(slow) > 80
    monkeypatch.undo()
    narrow = D.fixpoint(graph, none, history=False)
    assert {r["edge_id"]: r.asDict() for r in narrow.collect()} == {k: {c: v for c, v in r.items() if c in narrow.columns} for k, r in slow.items()}


def test_groups_of_rules_are_those_of_their_pairs(spark):
    """Lists of types give what pairs one by one give: repeated edges, loops that mustn't meet themselves, several ways, all geometries."""
    ends = [("x", "p"), ("y", "p"), ("p", "p"), ("p", "d"), ("p", "e"), ("q", "d"), ("x", "q"), ("p", "p2"), ("z", "q")]
    kinds = [t for t, _ in (("CanAssume", 0), ("CanReadData", 1), ("CanInvoke", 2), ("CanModifyCode", 3), ("CanModifyConfiguration", 4), ("CanPassIdentity", 5), ("ContainsResourceReference", 6), ("ExecutesAs", 7), ("CanTrigger", 8))]
    rows = [(t, s, d, "ACTIVE" if (k + n) % 3 else "CONDITIONAL", 1.0 + n % 2, 0.9) for n, t in enumerate(kinds) for k, (s, d) in enumerate(ends)]
    graph = D.normalized(edges(spark, *rows, rows[3], rows[12]))
    by = ["rule_id", "type", "source", "target", "state"]
    plain = D.join_rules(graph, graph).groupBy(*by).agg(F.count("*").alias("n"), F.min("weight").alias("weight"), F.max("confidence").alias("confidence"))
    grouped = D.rule_groups(graph, graph)
    assert sorted(map(tuple, grouped.collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 100
    # what leaves the grouping is one row for all types
    plan = grouped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")
