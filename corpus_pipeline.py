"""From raw documents to a training mix in five stages, each one a Parquet table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arcwarden.llm import common, decontam, langid, linededup, minhash, mixing

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near-duplicates of the pipeline share shingles of five words; the similarity is the operator's 0.8.
NEAR = minhash.MinHashConfig(width=5)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language that is certain enough go."""
    return langid.keep_identified(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose the lines that other documents repeat; ``n_chars``, where there is one, follows the text.

    Documents stay, even those left with an empty text: what is left of a text is the next stages' matter.
    """
    return linededup.with_lengths(linededup.dedup_lines(docs).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the smallest ``doc_id`` of each group stays."""
    return minhash.keep_first(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that overlap with a benchmark item go."""
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target asks for."""
    return mixing.draw_mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: Language identification and hashed candidates have no SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
