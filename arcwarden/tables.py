"""Tables between jobs: stored rounds of iterations, and broadcasts behind a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side of at most so many (narrow) rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all runs on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: ends the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/arcwarden-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast if the counted size allows it; ``df`` should be stored or cheap to count."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def config_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A configuration table; its size is that of the literal it comes from."""
    return spark.createDataFrame(rows, schema)
