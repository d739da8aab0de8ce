"""Facts behind edges, by their histories."""

from pyspark.sql import functions as F

from arcwarden.operators import export


def test_facts_come_down_long_and_cyclic_histories(spark):
    """A chain of twelve, a fork, a cycle, and a branch that ends at an edge with facts of its own."""
    rows = [("f0", ["a", "b"], []), ("f1", ["c"], ["f0"])]
    rows += [(f"d{k}", [], [f"d{k - 1}" if k else "f0"]) for k in range(12)]
    rows += [("fork", None, ["f1", "d3"]), ("x", [], ["y", "f1"]), ("y", [], ["x"]), ("lone", [], ["nowhere"]), ("none", None, None)]
    edges = spark.createDataFrame([(i, "s" + i, "t", f, d) for i, f, d in rows], "edge_id string, source string, target string, facts array<string>, derived_from array<string>")
    facts = spark.createDataFrame([("slone", "t", "by-ends"), ("sx", "t", "unused")], "source_ref string, target_ref string, fact_id string")
    found = {r["edge_id"]: (r["facts"], r["tier"]) for r in export.edge_fact_provenance(edges, facts).collect()}
    want = {"f0": (["a", "b"], "own"), "f1": (["c"], "own"), "fork": (["a", "b", "c"], "history"), "x": (["c"], "history"), "y": (["c"], "history"), "lone": (["by-ends"], "ends")}
    assert found == want | {f"d{k}": (["a", "b"], "history") for k in range(12)}
    assert export.edge_fact_provenance(edges.where(F.lit(False)), facts).count() == 0
