"""Quality classification with hierarchical empirical Bayes over sites and their sections.

A logistic regression on shares of bytes and words of the whole text gives each document's evidence. Documents belong to a
section of a site (for ``documents``: the source, and the language within it; for pages: host and first path segment). The
mean evidence of a site is shrunk to the global mean, that of a section to its site's, by prior strengths that the method of
moments estimates from the spread between sites (sections) beyond what their sizes explain: sparse sites stay near the
prior, large ones speak for themselves. A document's own evidence is left out of its site's, and the section's posterior
takes the place of the training prior in the document's odds:

    logit(posterior) = logit(document) - logit(training mean) + logit(section)

All statistics are grouped aggregations over every document. The classifier is fitted on a bounded sample of labelled rows.
The limit below which a document isn't kept is the ``lose`` quantile of the posteriors of documents labelled good, and at
most ``most_limit``.

Edge cases: null and empty texts have features of zeros; null sites and sections are sites and sections of their own;
labels without a document, null labels and repeated rows are fine; without any label of either kind every document has
evidence 0.5. Repeated rows get the same answer. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.llm.common import maybe_broadcast, small_batches, stored, table


@dataclass(frozen=True)
class QualityConfig:
    #: Labelled rows that the classifier is fitted on, by a hash of the id.
    max_labels: int = 8000
    ridge: float = 1.0
    steps: int = 25
    #: Share of labelled good documents that the limit may lose.
    lose: float = 0.002
    most_limit: float = 0.5
    #: Bounds of the prior strengths.
    strengths: tuple[float, float] = (1.0, 1e6)


SYMBOLS = b"|#$%&*!?.,;:-_/\\()[]{}<>=+~^@'\"`"
N_FEATURES = 15 + len(SYMBOLS)
_LETTERS = np.array([chr(c).isalpha() for c in range(128)] + [False] * 128)
_UPPER = np.array([chr(c).isupper() for c in range(128)] + [False] * 128)
_DIGIT = np.array([chr(c).isdigit() for c in range(128)] + [False] * 128)
_SPACE = np.array([c in b" \t\n\r\x0b\x0c" for c in range(256)])


def features(text: bytes | None) -> np.ndarray:
    """Shares of bytes, words and lines of a whole text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    letters = counts[_LETTERS].sum() + counts[128:].sum()
    out[:15] = (
        np.log1p(len(text)), len(text) / n / 10, len(set(words)) / n, len(set(words)) / n**0.7, sum(map(bytes.__eq__, words, words[1:])) / n,
        counts[_UPPER].sum() / max(letters, 1e-9), counts[_DIGIT].sum(), counts[_SPACE].sum(), counts[128:].sum(), 1 - letters - counts[_SPACE].sum(),
        len(set(lines)) / max(1, len(lines)), len(lines) / n, max(map(len, words), default=0) / 100, counts.max(), np.sqrt(1 - min(1.0, letters)),
    )
    out[15:] = np.sqrt(counts[np.frombuffer(SYMBOLS, np.uint8)])
    return out


def fit_classifier(docs: DataFrame, labels: DataFrame, config: QualityConfig) -> np.ndarray | None:
    """Weights (the last is the bias) of means, scales and coefficients; None without labels of both kinds."""
    small_batches(docs.sparkSession)
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = stored(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_labels), "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(v.as_py()).tolist() for v in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    sample = docs.select("doc_id", "text").join(maybe_broadcast(drawn), "doc_id").select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int"))
    rows = sorted(sample.mapInArrow(run, "doc_id long, quality int, x array<double>").collect(), key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([float(r["quality"] > 0) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([r["x"] for r in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = config.ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    weights = np.zeros(z.shape[1])
    for _ in range(config.steps):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        gradient = z.T @ (p - y) + penalty @ weights
        weights -= np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, gradient)
    return np.vstack([np.append(mean, 0), np.append(scale, 1), weights])


def score_documents(docs: DataFrame, model: np.ndarray | None) -> DataFrame:
    """``docs(doc_id, site, section, text)`` with the evidence ``doc_score`` in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if own is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                x = np.array([features(v.as_py()) for v in batch.column(3).cast(pa.binary())])
                scores = 1 / (1 + np.exp(-np.clip((x - own[0, :-1]) / own[1, :-1] @ own[2, :-1] + own[2, -1], -12, 12)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.float64())], ["doc_id", "site", "section", "doc_score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "site", "section", "text").mapInArrow(run, "doc_id long, site string, section string, doc_score double")


def _strength(stats: DataFrame, n: Column, mean: Column, prior: Column, config: QualityConfig) -> float:
    """Prior strength by the method of moments from rows of group sizes, means and their priors."""
    spread = F.sum(n * (mean - prior) * (mean - prior)) / F.sum(n)
    inside = F.sum(prior * (1 - prior)) / F.sum(n)
    variance = F.sum(n * prior * (1 - prior)) / F.sum(n)
    row = stats.agg(spread.alias("s"), inside.alias("i"), variance.alias("v")).first()
    if not row["v"]:
        return config.strengths[1]
    between = max(row["s"] - row["i"], row["v"] / config.strengths[1])
    return float(min(config.strengths[1], max(config.strengths[0], row["v"] / between - 1)))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def classify_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """``(doc_id, site, section, doc_score, site_posterior, section_posterior, quality, kept)`` of ``docs(doc_id, site, section, text)``."""
    scored = stored(score_documents(docs, fit_classifier(docs, labels, config)), "scores")
    total = scored.agg(F.avg("doc_score")).first()[0]
    mu = F.lit(float(total if total is not None else 0.5))
    sections = stored(scored.groupBy("site", "section").agg(F.count("*").alias("n2"), F.sum("doc_score").alias("s2")), "sections")
    sites = stored(sections.groupBy("site").agg(F.sum("n2").alias("n1"), F.sum("s2").alias("s1")), "sites")
    k1 = F.lit(_strength(sites, F.col("n1"), F.col("s1") / F.col("n1"), mu, config))
    shrunk = sites.select(F.col("site").alias("site_"), "n1", "s1")
    both = stored(sections.join(shrunk, _same("site", "site_")).drop("site_"), "sections")
    k2 = F.lit(_strength(both, F.col("n2"), F.col("s2") / F.col("n2"), (F.col("s1") + k1 * mu) / (F.col("n1") + k1), config))
    side = both.select(F.col("site").alias("site_"), F.col("section").alias("section_"), "n1", "s1", "n2", "s2")
    joined = scored.join(maybe_broadcast(side), _same("site", "site_") & _same("section", "section_"))
    others = lambda s, n, k, prior: (F.col(s) - F.col("doc_score") + k * prior) / (F.col(n) - 1 + k)
    site = others("s1", "n1", k1, mu)
    found = joined.withColumn("site_posterior", site).withColumn("section_posterior", others("s2", "n2", k2, F.col("site_posterior")))
    odds = _logit(F.col("doc_score")) - _logit(mu) + _logit(F.col("section_posterior"))
    done = stored(found.withColumn("quality", 1 / (1 + F.exp(-odds))).select("doc_id", "site", "section", "doc_score", "site_posterior", "section_posterior", "quality"), "quality")
    good = labels.where("quality > 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    limit = done.select("doc_id", "quality").join(good, "doc_id").agg(F.percentile_approx("quality", config.lose, 10_000)).first()[0]
    return done.withColumn("kept", F.col("quality") >= F.lit(float(min(config.most_limit, limit if limit is not None else 0.0))))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("site"), F.col("lang").alias("section"), "text")
    found = classify_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.withColumnRenamed("site", "source").withColumnRenamed("section", "lang")
