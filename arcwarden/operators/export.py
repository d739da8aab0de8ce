"""Provenance: evidence behind facts, facts behind edges, and the export of all records as one stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.functions.scalars import fact_id, last_seg, map_nature, map_node_type, norm_type, text
from arcwarden.operators.substrings import containing
from arcwarden.tables import small, stored


def content_hash(*columns: str) -> Column:
    """Hash of the columns' JSON; comparable within this engine only."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def node_ref_index(nodes: DataFrame) -> DataFrame:
    """``(ref, node)``: ids, arns and native tails; an id wins over an arn, an arn over a tail, then the smallest id."""
    tail = F.substring_index("node_id", "|", -1)
    refs = nodes.select("node_id", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("node_id").alias("ref")), F.struct(F.lit(1).alias("o"), text("arn").alias("ref")), F.struct(F.lit(2).alias("o"), tail.alias("ref")))).alias("r")).select("node_id", "r.*")
    return refs.where("ref != ''").groupBy("ref").agg(F.min(F.struct("o", "node_id")).alias("b")).select("ref", F.col("b.node_id").alias("node"))


def resolve_ref(df: DataFrame, column: str, index: DataFrame, out: str) -> DataFrame:
    """``df`` with the node that ``column`` names: as it is, or by its last segment; unchanged where neither is known."""
    whole = index.select(F.col("ref").alias("_w"), F.col("node").alias("_whole"))
    part = index.select(F.col("ref").alias("_p"), F.col("node").alias("_part"))
    met = df.join(whole, F.col(column) == F.col("_w"), "left").join(part, last_seg(column) == F.col("_p"), "left")
    return met.withColumn(out, F.coalesce("_whole", "_part", column)).drop("_w", "_whole", "_p", "_part")


def ledger_evidence(ledger: DataFrame) -> DataFrame:
    """One piece of evidence for each task."""
    digest = content_hash("task_id", "operation", "resource_type", "status")
    id_ = F.when(text("task_id") != "", F.concat(F.lit("ev:op-"), F.col("task_id"))).otherwise(F.concat(F.lit("ev:sha256-"), F.substring(digest, 1, 16)))
    return ledger.select(id_.alias("evidence_id"), F.concat(F.lit("sha256:"), digest).alias("content_hash"), F.col("operation").alias("source"), "status", "resource_type", F.col("ended_at").alias("at")).dropDuplicates(["evidence_id"])


def fact_records(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Facts with their id, hash and resolved ends."""
    named = facts.withColumn("fact_id", fact_id("provider", "kind", "source", "target", "edge_hint", "scope.account")).withColumn("content_hash", F.concat(F.lit("sha256:"), content_hash("provider", "kind", "source", "target", "edge_hint")))
    index = stored(node_ref_index(nodes), "refs")
    both = resolve_ref(resolve_ref(named, "source", index, "source_ref"), "target", index, "target_ref")
    return both.select("fact_id", F.col("kind").alias("fact_type"), "provider", "content_hash", "source_ref", "target_ref").dropDuplicates(["fact_id"])


def fact_evidence_link(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(fact_id, evidence_id)`` where the normalised fact type and resource type contain each other.

    Only the distinct types of both sides meet, in joins on n-grams, and then the rows by equality.
    """
    types = facts.select(norm_type("fact_type").alias("f")).distinct().where("f != ''")
    kinds = evidence.select(norm_type("resource_type").alias("r")).distinct().where("r != ''")
    as_text, as_pattern = (lambda df, c: df.select(F.col(c).alias("text"))), (lambda df, c: df.select(F.col(c).alias("pattern")))
    one = containing(as_text(types, "f"), as_pattern(kinds, "r")).select(F.col("text").alias("f"), F.col("pattern").alias("r"))
    other = containing(as_text(kinds, "r"), as_pattern(types, "f")).select(F.col("pattern").alias("f"), F.col("text").alias("r"))
    alike = stored(one.unionByName(other).distinct(), "alike")
    return facts.select("fact_id", norm_type("fact_type").alias("f")).join(small(alike), "f").join(evidence.select("evidence_id", norm_type("resource_type").alias("r")), "r").select("fact_id", "evidence_id").distinct()


def edge_fact_provenance(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """``(edge_id, facts, tier)``: the edge's own facts; else those that its history leads to; else facts of the same ends.

    Facts are pushed down the histories: a round hands what edges without facts of their own have newly got to the edges made
    of them, so rows are those of the answer, and a cycle ends where nothing is new.
    """
    rows = stored(edges.select("edge_id", "source", "target", F.coalesce("facts", F.array().cast("array<string>")).alias("facts"), F.coalesce("derived_from", F.array().cast("array<string>")).alias("derived_from")), "edges")
    own = rows.where(F.size("facts") > 0).select("edge_id", F.array_sort(F.array_distinct("facts")).alias("facts"), F.lit("own").alias("tier"))
    steps = stored(rows.where(F.size("facts") == 0).select(F.col("edge_id").alias("made"), F.explode("derived_from").alias("edge_id")).distinct(), "steps")
    fresh = stored(own.select("edge_id", F.explode("facts").alias("fact")), "pushed")
    n, got = fresh.count(), []
    while n:
        offers = stored(steps.join(small(fresh, n), "edge_id").select(F.col("made").alias("edge_id"), "fact").distinct(), "offers")
        fresh = offers
        for before in got:
            fresh = fresh.join(before, ["edge_id", "fact"], "left_anti")
        fresh = stored(fresh, "pushed")
        n = fresh.count()
        got.append(fresh)
        if len(got) > 6:  # few tables to look into, however long the histories
            every = got[0]
            for g in got[1:]:
                every = every.unionByName(g)
            got = [stored(every, "got")]
    through = rows.select("edge_id", F.lit("").alias("fact")).where("false")
    for g in got:
        through = through.unionByName(g)
    transitive = through.groupBy("edge_id").agg(F.array_sort(F.collect_set("fact")).alias("facts")).withColumn("tier", F.lit("history"))
    settled = own.unionByName(transitive)
    left = rows.join(settled.select("edge_id"), "edge_id", "left_anti").select("edge_id", "source", "target")
    same = facts.select(F.col("source_ref").alias("source"), F.col("target_ref").alias("target"), "fact_id")
    by_ends = left.join(same, ["source", "target"]).groupBy("edge_id").agg(F.array_sort(F.collect_set("fact_id")).alias("facts")).withColumn("tier", F.lit("ends"))
    return settled.unionByName(by_ends)


def edge_evidence(edges: DataFrame, provenance: DataFrame, links: DataFrame) -> DataFrame:
    """``(edge_id, evidence)``: evidence of the edge's facts; else one made of the inline evidence or the rule's name."""
    via = provenance.select("edge_id", F.explode("facts").alias("fact_id")).join(links, "fact_id").groupBy("edge_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence"))
    inline = F.coalesce(F.nullif("evidence", F.lit("")), F.when(F.col("nature") == "derived", F.concat(F.lit("rule:"), text("rule_id"))))
    rest = edges.join(via.select("edge_id"), "edge_id", "left_anti").withColumn("said", inline).where("said is not null")
    made = rest.select("edge_id", F.array(F.concat(F.lit("ev:sha256-"), F.substring(F.sha2("said", 256), 1, 16))).alias("evidence"))
    return via.unionByName(made)


def export_manifest(nodes: DataFrame, edges: DataFrame, foothold: DataFrame | None = None, spec_version: str = "1.0") -> DataFrame:
    """One row: version, providers, foothold and counts."""
    counts = nodes.agg(F.count("*").alias("nodes"), F.array_sort(F.collect_set("provider")).alias("providers")).join(edges.agg(F.count("*").alias("edges")))
    found = foothold.select(F.col("node").alias("foothold")).limit(1) if foothold is not None else nodes.limit(1).select(F.lit(None).cast("string").alias("foothold"))
    return counts.join(found, how="left").select(F.lit(spec_version).alias("spec_version"), "providers", "foothold", "nodes", "edges")


def export_records(manifest: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame | None = None, evidence: DataFrame | None = None, findings: DataFrame | None = None, surfaces: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """``(ord, kind, id, record)``: every record as JSON with its kind; the manifest sorts first."""
    kinds = [("manifest", manifest, F.lit("manifest")), ("node", nodes.withColumn("node_type", map_node_type("node_type")), F.col("node_id")), ("evidence", evidence, F.col("evidence_id")), ("fact", facts, F.col("fact_id")), ("edge", edges.withColumn("nature", map_nature("nature")), F.col("edge_id")), ("finding", findings, F.concat_ws("|", "site_id", "resource_id", "value_ref")), ("surface", surfaces, F.concat_ws("|", "site_id", "resource_id")), ("path", paths, F.col("path_id"))]
    out = None
    for k, (kind, frame, id_) in enumerate(kinds):
        if frame is not None:
            rows = frame.select(F.lit(k).alias("ord"), F.lit(kind).alias("kind"), id_.alias("id"), F.to_json(F.struct(F.lit(kind).alias("kind"), *[c for c in frame.columns if c != "kind"])).alias("record"))
            out = rows if out is None else out.unionByName(rows)
    return out
