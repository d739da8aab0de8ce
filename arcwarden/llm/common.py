"""Shared plumbing of the training-data operators: shared-folder tables, size-checked broadcasts, Arrow batches."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwarden.packaging import ship

#: Rows of one Arrow batch: bounds a Python worker's memory when texts are very long.
BATCH_ROWS = 512
#: A join side of at most so many rows is broadcast (ids and small keys only); a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Word separators of the corpus contract: space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Ready the session for Python over whole texts: the package on the workers, and Arrow batches of ``rows``."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/arcwarden-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives the loss of any executor."""
    path = fresh_path(df.sparkSession, what)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted size is within ``limit``; otherwise leave the join to a shuffle.

    ``df`` should be a stored table of ids, so that the count is cheap.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def global_row_number(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with its rows numbered from 1 in the order given: numbers within range partitions, plus the rows before each.

    What the driver gets is one count for each partition.
    """
    parts = stored(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, start = [], 0
    for part, n in sorted(map(tuple, parts.groupBy("_part").count().collect())):
        before += [F.lit(part), F.lit(start).cast("long")]
        start += n
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn(name, own + F.create_map(*before)[F.col("_part")] if before else own).drop("_part")


def n_words(text: Column | str) -> Column:
    """Number of runs of characters other than space and ``\\t`` to ``\\r``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def raw_texts(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, one value at a time, without decoding."""
    for value in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()):
        yield value.as_py()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def schema_with(df: DataFrame, more: str) -> T.StructType:
    """The frame's schema and the fields of a DDL string after it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns named by position, so that added ones can't clash, and the new name of each old one."""
    names = [f"_in{k}" for k in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(28))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.cache
def _random_values(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def letter_values() -> np.ndarray:
    """A random number for each letter and digit (the same for upper and lower case) by code point; 0 for all else, which separates words."""
    values, out = _random_values(0x110000, 17), np.zeros(0x110000, np.uint64)
    for c in range(0x110000):
        if (s := chr(c)).isalnum():
            out[c] = values[ord(s.lower()[0])]
    return out


@functools.cache
def byte_values() -> np.ndarray:
    """A random number for each byte (the same for A to Z and a to z); 0 for the white space of ``WORD``."""
    out = _random_values(256, 19).copy()
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


def run_hashes(values: np.ndarray, alone: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the runs of numbers other than 0; where ``alone`` is set, a number is a run by itself."""
    on = values != 0
    start = on.copy()
    start[1:] &= ~on[:-1]
    if alone is not None:
        start |= alone
        start[1:] |= alone[:-1] & on[1:]
    inner, first = values[on], np.flatnonzero(start[on])
    if not len(first):
        return np.zeros(0, np.uint64)
    place = np.arange(len(inner)) - np.repeat(first, np.diff(np.append(first, len(inner))))
    return mix64(np.add.reduceat(inner * _random_values(4096, 23)[place & 4095], first))


def whole_runs(data: np.ndarray, values: np.ndarray, chunk: int, alone: Callable[[np.ndarray], np.ndarray | None] = lambda part: None) -> np.ndarray:
    """``run_hashes`` of ``values[data]``, some ``chunk`` items at a time, cut between runs, which bounds memory on very long texts."""
    out, at, size = [], 0, chunk
    while at < len(data):
        part = data[at : at + size]
        own = values[part]
        if at + size < len(data):
            gaps = np.flatnonzero(own == 0)
            if not len(gaps):
                size *= 2
                continue
            part, own = part[: gaps[-1] + 1], own[: gaps[-1] + 1]
        out.append(run_hashes(own, alone(part)))
        at, size = at + len(part), chunk
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def byte_word_ids(text: bytes, chunk: int = 1 << 20) -> np.ndarray:
    """64-bit ids of the words ``WORD`` of UTF-8 bytes, A to Z lower-cased."""
    return whole_runs(np.frombuffer(text, np.uint8), byte_values(), chunk)


def without_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``ids`` (a stored one-column table); rows with a null id stay."""
    return docs.join(maybe_broadcast(ids.select(column).distinct()), column, "left_anti").select(*docs.columns)
