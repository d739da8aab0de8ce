"""Credential-shaped values in JSON and text; findings hold fingerprints and places, never the values."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.catalog import CREDENTIAL_MARKERS, HARD_LOCATIONS
from arcwarden.functions.scalars import C, shannon_entropy, text
from arcwarden.tables import small, stored


def path_steps(path: str) -> list[list[str]]:
    """The alternatives of a path, each as its steps; ``a[]`` is a step into ``a`` and one over its elements."""
    out = []
    for alternative in path.split("/"):
        steps: list[str] = []
        for part in (p.strip() for p in alternative.strip().split(".")):
            if part:
                name = part.removesuffix("[]")
                steps += [name] * bool(name) + ["[]"] * part.endswith("[]")
        if steps:
            out.append(steps)
    return out


def extract_path(df: DataFrame, json: str, path: str, value: str = "value") -> DataFrame:
    """``df`` once for each non-blank scalar at ``path`` of its JSON column: ``A.B``, ``A[].B``, ``<any>`` for all values of an
    object, ``X / Y`` for either. All steps but the last few stay arrays of JSON texts, so nothing is joined."""
    found = [_walk(F.array(F.col(json)), steps) for steps in path_steps(path)]
    if not found:
        return df.withColumn(value, F.lit(None).cast("string")).where("false")
    every = F.flatten(F.array(*found))
    scalars = F.filter(every, lambda v: v.isNotNull() & (F.trim(v) != "") & ~v.rlike(r"^\s*[\{\[]"))
    return df.withColumn(value, F.explode(scalars))


def _into(step: str) -> Callable[[Column], Column]:
    """What one step makes of a JSON text: its elements, all its values, or one of them."""
    if step == "[]":
        return lambda n: F.when(n.startswith("["), F.from_json(n, "array<string>"))
    held = lambda n: F.from_json(n, "map<string,string>")
    if step.startswith("<"):
        return lambda n: F.when(n.startswith("{"), F.map_values(held(n)))
    return lambda n: F.when(n.startswith("{"), F.array(F.try_element_at(held(n), F.lit(step))))


def _walk(nodes: Column, steps: list[str]) -> Column:
    for step in map(_into, steps):
        found = F.flatten(F.transform(nodes, lambda n: F.coalesce(step(n), F.array().cast("array<string>"))))  # noqa: B023
        nodes = F.filter(found, lambda n: n.isNotNull())
    return nodes


def credential_pattern(value: C) -> Column:
    """Whether the value holds a credential's marker; without case."""
    return F.regexp_like(text(value), F.lit("(?i)" + "|".join(re.escape(m) for m in CREDENTIAL_MARKERS)))


def looks_like_token(value: C) -> Column:
    """At least 20 bytes without white space, of more than 3.5 bits of entropy a byte."""
    v = text(value)
    return F.when((F.octet_length(v) >= 20) & ~v.rlike(r"[ \t\r\n]"), shannon_entropy(v) > 3.5).otherwise(F.lit(False))


def assess(value: C, location_kind: C) -> Column:
    """``struct<hit, confidence>`` of a value at a kind of location."""
    v, kind = F.trim(text(value)), text(location_kind)
    judge = lambda hit, c: F.struct(F.lit(hit).alias("hit"), F.lit(c).alias("confidence"))
    return F.when(v == "", judge(False, 0.0)).when(credential_pattern(v), judge(True, 0.99)).when(kind.isin(*HARD_LOCATIONS), judge(True, 0.75)).when(looks_like_token(v), judge(True, 0.8)).otherwise(judge(False, 0.2))


def fingerprint(value: C, salt: str) -> Column:
    """Salted hash, byte length and the last four characters."""
    v = text(value)
    tail = F.when(v == "", F.lit("")).otherwise(F.concat(F.lit("…"), F.right(v, F.lit(4))))
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat(F.lit(salt), v), 256), 1, 16), F.lit(" len="), F.octet_length(v).cast("string"), F.lit(" "), tail)


def surface_gate(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites whose values may be looked at, and those that only become surfaces."""
    readable = F.col("access_mode") == "read_api"
    return sites.where(readable), sites.where(~F.coalesce(readable, F.lit(False)))


def _all_values(body: Column, steps: Column) -> Column:
    """Scalars at a path given as an array of steps: one walk for all paths, each step chosen by its word."""

    def step(nodes: Column, word: Column) -> Column:
        held = lambda n: F.from_json(n, "map<string,string>")
        into = lambda n: (
            F.when(word == "[]", F.when(n.startswith("["), F.from_json(n, "array<string>")))
            .when(word.startswith("<"), F.when(n.startswith("{"), F.map_values(held(n))))
            .otherwise(F.when(n.startswith("{"), F.array(F.try_element_at(held(n), word))))
        )
        found = F.flatten(F.transform(nodes, lambda n: F.coalesce(into(n), F.array().cast("array<string>"))))
        return F.filter(found, lambda n: n.isNotNull())

    every = F.aggregate(steps, F.array(body), step)
    return F.filter(every, lambda v: (F.trim(v) != "") & ~v.rlike(r"^\s*[\{\[]"))


def detect_sensitive(responses: DataFrame, sites: DataFrame, salt: str = "") -> DataFrame:
    """Findings of ``responses(operation, resource_type, resource_id, body)`` at ``sites(site_id, operation, resource_type, response_path,
    location, location_kind, emits_hint, severity)``. Responses are scanned once, however many paths the sites have: a site's path
    is a column of steps, and each response walks those of its own operation and type."""
    paths = sites.select("response_path").where(text("response_path") != "").distinct()
    words = F.transform(F.split("response_path", "/"), lambda p: F.flatten(F.transform(F.filter(F.split(F.trim(p), r"\."), lambda w: F.trim(w) != ""), lambda w: F.filter(F.array(F.regexp_replace(F.trim(w), r"\[\]$", ""), F.when(F.trim(w).endswith("[]"), "[]")), lambda x: x.isNotNull() & (x != "")))))
    alternatives = paths.withColumn("steps", F.explode(words)).where(F.size("steps") > 0)
    looked = stored(sites.join(alternatives, "response_path"), "sites")
    met = responses.join(small(looked), ["operation", "resource_type"]).withColumn("value", F.explode(_all_values(F.col("body"), F.col("steps"))))
    hits = met.withColumn("a", assess("value", "location_kind")).where("a.hit")
    return hits.select("site_id", "resource_id", "location", "emits_hint", "severity", F.col("a.confidence").alias("confidence"), fingerprint("value", salt).alias("value_ref")).distinct()


def site_outcomes(sites: DataFrame, responses: DataFrame, inventory_types: DataFrame, findings: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``(site_id, outcome, n)``: ok with its hits, empty, no response type, nothing in the inventory, or an error without hits."""
    readable, _ = surface_gate(sites)
    probed = responses.select("operation", "resource_type").distinct().withColumn("probed", F.lit(True))
    listed = inventory_types.select("resource_type").distinct().withColumn("listed", F.lit(True))
    hits = findings.groupBy("site_id").agg(F.count("*").alias("n"))
    failed = (errors.groupBy("site_id").agg(F.min("reason").alias("reason")) if errors is not None else readable.select("site_id", F.lit(None).cast("string").alias("reason")).where("false"))
    met = readable.join(probed, ["operation", "resource_type"], "left").join(listed, "resource_type", "left").join(hits, "site_id", "left").join(failed, "site_id", "left")
    outcome = F.when(F.col("n") > 0, "ok").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("probed").isNull(), "no_probe_impl").when(F.col("listed").isNull(), "no_inventory_targets").otherwise("empty")
    return met.select("site_id", outcome.alias("outcome"), F.coalesce("n", F.lit(0)).alias("n"))
