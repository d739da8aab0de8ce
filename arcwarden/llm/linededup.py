"""Line deduplication over levelled sorted runs of line hashes.

A document's lines are keyed by their stripped, ASCII-lower-cased form; keys of at least ``min_chars`` code points count.
The documents fall into batches by descending ``doc_id``. Each batch summarises its keys (hash, number of documents,
largest document) and merge-anti-joins the runs written so far: keys that the runs already hold as settled (seen in at least
``min_docs`` documents) bring nothing new, as their largest document lies in an earlier batch; the rest become the batch's
own sorted run. Two runs of one level are merged into one run of the next level, so that a batch meets one run of each level
at most, a logarithm of the batches. After the last batch the runs are merged once more, and keys in at least ``min_docs`` documents lose their lines
in all documents but the largest.

Runs are bucketed tables in the shared folder, sorted by hash inside buckets by hash: a lost executor costs a re-run of tasks
only. All runs have the same buckets, and a batch's keys, counted before they move, are dealt to them once; merges and
anti-joins then read the runs as they lie, without moving them again. A batch is a share of the corpus and as distributed as
the corpus is, so batches grow with it, and their number doesn't; ``part_lines`` sets how many buckets there are.

Edge cases: a null or empty text is one empty line; repeated rows of a ``doc_id`` are one document; a row without a
``doc_id`` neither counts nor loses lines; a text that loses every line becomes the empty string. An empty table gives an
empty result. Extra columns pass through; ``n_lines`` and ``n_dropped`` of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwarden.llm.common import fresh_path, maybe_broadcast, positional, schema_with, small_batches, stored, table

@dataclass(frozen=True)
class LineDedupConfig:
    min_chars: int = 20
    min_docs: int = 3
    #: Shares of the corpus by id that are taken one after the other, and lines for each bucket of a run.
    batches: int = 5
    part_lines: int = 1_000_000


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A to Z lower-cased."""
    return line.strip().lower()


def line_hash(key: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a key of at least ``min_chars`` code points."""
    import xxhash

    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_table(docs: DataFrame, config: LineDedupConfig, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, hash)``: each document's distinct countable keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, counts = batch.column(0), [], []
            for value in batch.column(1).cast(pa.binary()):
                found = {h for line in (value.as_py() or b"").split(b"\n") if (h := line_hash(line_key(line), config.min_chars))}
                hashes.extend(found)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids.to_numpy(zero_copy_only=False), counts), pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "hash"])

    small_batches(docs.sparkSession)
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long"), F.col(text))
    return rows.mapInArrow(run, "doc_id long, hash binary")


def _merged(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two runs as one, by a merge join of their buckets: a union of bucketed tables would have to be dealt out anew."""
    other = two.select("hash", F.col("n_docs").alias("_n"), F.col("max_doc").alias("_max"))
    both = one.hint("merge").join(other, "hash", "full")
    return both.select("hash", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "_max").alias("max_doc"))


class Runs:
    """The runs of one pass, at most one of each level, as external tables of the catalog.

    ``drop`` forgets the tables, their files stay in the shared folder.
    """

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.levels: list[DataFrame | None] = []
        self.names: list[str] = []

    def all(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    def _written(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, "run")
        self.names.append(path.rsplit("/", 1)[1].replace("-", "_"))
        df.select("hash", "n_docs", "max_doc").sortWithinPartitions("hash").write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def add(self, own: DataFrame) -> None:
        """A new run of the lowest level; two runs of a level become one of the next."""
        run, k = self._written(own), 0
        while k < len(self.levels) and self.levels[k] is not None:
            run, self.levels[k], k = self._written(_merged(self.levels[k], run)), None, k + 1
        self.levels[k : k + 1] = [run]

    def merged(self) -> DataFrame:
        """All runs as one, from the smallest up."""
        every = self.all()
        run = every[0]
        for k, other in enumerate(every[1:]):
            run = _merged(run if k == 0 else self._written(run), other)
        return run

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _news(batch: DataFrame, runs: Runs, config: LineDedupConfig) -> DataFrame:
    """Counts of a batch's keys that the runs don't hold as settled, dealt to the runs' buckets.

    Each run meets the batch in a merge join that keeps the batch's keys, and the counts found are added up: an anti-join
    proper would be pushed below the counting, and meet every line.
    """
    own = batch.groupBy("hash").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc")).repartition(runs.buckets, "hash").withColumn("before", F.lit(0).cast("long"))
    for run in runs.all():
        own = own.hint("merge").join(run.select("hash", F.col("n_docs").alias("_n")), "hash", "left").withColumn("before", F.col("before") + F.coalesce("_n", F.lit(0))).drop("_n")
    return own.where(F.col("before") < config.min_docs).drop("before")


def repeated_lines(lines: DataFrame, config: LineDedupConfig) -> DataFrame:
    """``(hash, max_doc)`` of the keys found in at least ``min_docs`` documents, stored, from a stored ``(doc_id, hash)`` table."""
    spark = lines.sparkSession
    n, low, high = lines.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    if not n:
        return spark.createDataFrame([], "hash binary, max_doc long")
    edges = lines.approxQuantile("doc_id", [k / config.batches for k in range(1, config.batches)], 0.01) if high > low and config.batches > 1 else []
    edges = sorted({int(x) for x in edges} | {low})
    runs = Runs(spark, max(4, -(-n // config.part_lines)))
    try:
        for start, end in reversed(list(zip(edges, [*edges[1:], high + 1], strict=True))):
            runs.add(_news(lines.where((F.col("doc_id") >= start) & (F.col("doc_id") < end)), runs, config))
        return stored(runs.merged().where(F.col("n_docs") >= config.min_docs).select("hash", "max_doc"), "repeated")
    finally:
        runs.drop()


def dedup_lines(docs: DataFrame, config: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """``docs`` with the text's repeated lines dropped, and ``n_lines`` (before) and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped")
    lines = stored(line_table(docs, config), "lines")
    repeated = repeated_lines(lines, config)
    losing = lines.join(maybe_broadcast(repeated), "hash").where(F.col("doc_id") != F.col("max_doc"))
    drops = stored(losing.groupBy("doc_id").agg(F.collect_set("hash").alias("_hashes")), "drops")
    n_drops = drops.agg(F.count("*"), F.coalesce(F.sum(F.size("_hashes")), F.lit(0))).first()
    plain, names = positional(docs)
    side = drops.withColumnRenamed("doc_id", "_doc")
    joined = plain.join(maybe_broadcast(side, n_drops[0] + n_drops[1]), plain[names["doc_id"]].cast("long") == F.col("_doc"), "left").drop("_doc")
    kept = joined.drop("_hashes")
    columns = kept.columns
    at = columns.index(names["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for value, hashes in zip(batch.column(at).cast(pa.binary()), batch.column("_hashes"), strict=True):
                text = value.as_py()
                parts = (text or b"").split(b"\n")
                n_lines.append(len(parts))
                if drop := set(hashes.as_py() or ()):
                    stay = [p for p in parts if line_hash(line_key(p), config.min_chars) not in drop]
                    texts.append(b"\n".join(stay))
                    n_dropped.append(len(parts) - len(stay))
                else:
                    texts.append(text)
                    n_dropped.append(0)
            values = [batch.column(name) for name in columns]
            values[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*values, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*columns, "n_lines", "n_dropped"])

    small_batches(docs.sparkSession)
    return joined.mapInArrow(run, schema_with(kept, "n_lines long, n_dropped long")).toDF(*docs.columns, "n_lines", "n_dropped")


def with_lengths(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, if it has that column, set to the text's length."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def op10_linededup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: White space of the contract, for DuckDB's trim().
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, g.i AS i, string_split(coalesce(text, ''), chr(10)) AS parts, parts[g.i] AS line
  FROM documents, generate_series(1, len(string_split(coalesce(text, ''), chr(10)))) AS g(i)
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (h.k IS NOT NULL AND h.keep <> d.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(d.line, chr(10) ORDER BY d.i) FILTER (h.k IS NULL OR h.keep = d.doc_id), '')) AS kept_sha256
FROM keyed d LEFT JOIN hot h ON d.k = h.k
GROUP BY d.doc_id
"""
