"""The collection ledger: states of tasks, what is left to do, and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.functions.scalars import text

DONE = ("ok", "empty", "denied", "skipped")


def ledger_state(events: DataFrame) -> DataFrame:
    """The last event of each ``task_id`` by ``ts``; equal times go to the larger content."""
    rest = [c for c in events.columns if c != "task_id"]
    return events.groupBy("task_id").agg(F.max_by(F.struct(*rest), F.struct("ts", *[c for c in rest if c != "ts"])).alias("e")).select("task_id", "e.*")


def resume_todo(seeds: DataFrame, prior: DataFrame) -> DataFrame:
    """``seeds`` with ``status`` and ``reason``: planned, or skipped where an earlier run settled them."""
    settled = prior.where(F.col("status").isin(*DONE)).select("task_id").distinct()
    todo = seeds.join(settled, "task_id", "left_anti").withColumn("status", F.lit("planned")).withColumn("reason", F.lit(None).cast("string"))
    kept = seeds.join(settled, "task_id", "left_semi").withColumn("status", F.lit("skipped")).withColumn("reason", F.lit("resumed_prior_run"))
    return todo.unionByName(kept)


def ledger_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("n"))


def ledger_integrity(ledger: DataFrame) -> DataFrame:
    """One row: tasks still open, and whether there are none."""
    return ledger.agg(F.count_if(F.col("status").isin("running", "planned")).alias("open")).withColumn("ok", F.col("open") == 0)


def service_of(resource_type: str) -> Column:
    return F.when(F.instr(text(resource_type), ":") > 0, F.split_part(text(resource_type), F.lit(":"), F.lit(2))).otherwise(text(resource_type))


def coverage_report(ledger: DataFrame) -> DataFrame:
    """``(part, key, n)``: outcomes, denied and failed operations, skip reasons (surfaces folded), resources by service, empty tasks.

    A task says which parts it counts in, so the ledger is read and grouped once.
    """
    reason = F.when(text("reason").startswith("surface:"), "surface:*").otherwise(text("reason"))
    one, status = F.lit(1).cast("long"), F.col("status")
    counted = lambda name, key, n: F.struct(F.lit(name).alias("part"), key.alias("key"), n.cast("long").alias("n"))
    parts = F.array_compact(
        F.array(
            counted("outcome", status, one), F.when(status == "denied", counted("denied", F.col("operation"), one)), F.when(status == "error", counted("errored", F.col("operation"), one)),
            F.when(status == "skipped", counted("skipped", reason, one)), F.when(status == "ok", counted("service", service_of("resource_type"), F.col("count"))), F.when(status == "empty", counted("empty", F.lit("total"), one)),
        )
    )
    return ledger.select(F.inline(parts)).groupBy("part", "key").agg(F.sum("n").alias("n")).select("part", "key", "n")


def denied_permissions(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'denied'").select("operation").distinct()


def required_permissions(registry: DataFrame) -> DataFrame:
    """Distinct permissions over all resource types of ``registry(required_permissions)``."""
    return registry.select(F.explode("required_permissions").alias("permission")).distinct()


def top_services(ledger: DataFrame, top: int = 15) -> DataFrame:
    """``(service, n, position)``: the services of most resources, and one row for all others."""
    counts = ledger.where("status = 'ok'").groupBy(service_of("resource_type").alias("service")).agg(F.sum("count").alias("n"))
    first = counts.orderBy(F.desc("n"), "service").limit(top)
    rest = counts.join(first.select("service"), "service", "left_anti").agg(F.sum("n").alias("n")).where("n is not null").select(F.lit("(other)").alias("service"), "n")
    return first.unionByName(rest)
