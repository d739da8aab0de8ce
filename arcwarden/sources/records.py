"""Readers and writers of bundles: newline-delimited JSON in, tables out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwarden import schemas



def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(schema))


def read_ndjson(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """All ``*.ndjson`` files of a folder, or one file; a missing path is an empty table. JSON bags stay texts."""
    reader = spark.read.schema(T.StructType.fromDDL(schema)).option("mode", mode).option("pathGlobFilter", "*.ndjson")
    try:
        return reader.json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return _empty(spark, schema)
        raise


def read_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts; one bad line fails the job."""
    return read_ndjson(spark, f"{folder}/inventory", schemas.ARTIFACT)


def read_facts(spark: SparkSession, folder: str) -> DataFrame:
    return read_ndjson(spark, f"{folder}/facts", schemas.FACT)


def read_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings; bad lines are dropped one by one."""
    return read_ndjson(spark, f"{folder}/exposure/hits.ndjson", schemas.FINDING, "DROPMALFORMED")


def read_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    return read_ndjson(spark, f"{folder}/exposure/surfaces.ndjson", schemas.SURFACE, "DROPMALFORMED")


def read_ledger(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    return read_ndjson(spark, f"{folder}/ledger.ndjson", schemas.LEDGER, "FAILFAST" if strict else "DROPMALFORMED")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The bundle's header; empty if there is none."""
    try:
        return spark.read.schema(T.StructType.fromDDL(schemas.MANIFEST)).option("multiLine", True).json(f"{folder}/manifest.json")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return _empty(spark, schemas.MANIFEST)
        raise


def record_kind(record: Column) -> Column:
    """Kind of a JSON record, by its own word or by its fields."""
    get = lambda k: F.nullif(F.get_json_object(record, f"$.{k}"), F.lit(""))
    return F.coalesce(
        get("kind"),
        F.when(get("edge_id").isNotNull() | get("source").isNotNull() & get("target").isNotNull(), "edge").when(get("node_id").isNotNull(), "node").when(get("access_mode").isNotNull(), "surface")
        .when(get("resource_id").isNotNull() | get("value").isNotNull() | get("value_ref").isNotNull(), "finding").otherwise("other"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, record)`` of a mixed stream of JSON lines; lines that are no JSON are dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(F.expr("try_parse_json(value) is not null")).select(record_kind(F.col("value")).alias("kind"), F.col("value").alias("record"))


def records_of(records: DataFrame, kind: str, schema: str) -> DataFrame:
    return records.where(F.col("kind") == kind).select(F.from_json("record", T.StructType.fromDDL(schema)).alias("r")).select("r.*")


REGISTRY = "struct<node_type:string,scope:string,enumerate:struct<operation:string,id_field:string,arn_field:string,attributes:array<string>,yields:array<string>>,detail:array<struct<operation:string,bind:map<string,string>,capture:array<string>>>,required_permissions:array<string>>"
SITE = "struct<id:string,location:string,location_kind:string,data_kinds:array<string>,read:struct<access_mode:string,operation:string,response_path:string,encoding:string>,emits:string,severity:string>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Resource types of a JSON object keyed by type; the key becomes a column."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,{REGISTRY}>")).alias("resource_type", "r")).select("resource_type", "r.*").orderBy("resource_type")


def read_exposure_sites(spark: SparkSession, path: str) -> DataFrame:
    """Sites of a catalogue's services; the service loses its provider's prefix."""
    whole = spark.read.option("wholetext", True).text(path)
    services = whole.select(F.explode(F.from_json(F.get_json_object("value", "$.services"), f"map<string,struct<sites:array<{SITE}>>>")).alias("key", "s"))
    return services.select(F.substring_index("key", ":", -1).alias("service"), F.explode("s.sites").alias("x")).select("service", "x.*").orderBy("id")


def read_vocab(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """``(class, name)`` of a vocabulary: an object of lists, or one list."""
    whole = spark.read.option("wholetext", True).text(path)
    raw = F.get_json_object("value", f"$.{field}") if field else F.col("value")
    listed = F.when(F.trim(raw).startswith("["), F.map_from_arrays(F.array(F.lit("")), F.array(F.from_json(raw, "array<string>")))).otherwise(F.from_json(raw, "map<string,array<string>>"))
    return whole.select(F.explode(listed).alias("class", "names")).select("class", F.explode("names").alias("name"))


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, paths: DataFrame | None = None, resume: bool = False, fmt: str = "parquet") -> None:
    """Three tables under ``path``; a fresh run replaces them, a resumed one appends."""
    for name, df in (("nodes", nodes), ("edges", edges), ("paths", paths)):
        if df is not None:
            df.write.mode("append" if resume else "overwrite").format(fmt).save(f"{path}/{name}")


def write_manifest(path: str, nodes: DataFrame, edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """One row of counts, written as JSON and returned."""
    counts = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))
    counts = counts.join(paths.agg(F.count("*").alias("paths"))) if paths is not None else counts.withColumn("paths", F.lit(0).cast("long"))
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return counts


#: Columns of each kind of list that analysts take away.
EXPORTS = {"reachable": ["node", "depth"], "paths": ["start", "node", "cost", "hops", "state"], "leaks": ["kind", "node", "severity", "detail", "value_ref"], "exposures": ["kind", "node", "label", "severity", "detail", "reachable"]}


def export_findings(rows: DataFrame, what: str, path: str | None = None, fmt: str = "csv") -> DataFrame:
    """The columns of ``reachable``, ``paths``, ``leaks`` or ``exposures``; written as csv with a header, or json."""
    out = (rows.where("kind = 'credential'") if what == "leaks" else rows).select(*EXPORTS[what])
    if path:
        writer = out.write.mode("overwrite")
        writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)
    return out


