"""Language identification: averaged hashed subword embeddings and a linear softmax.

Character n-grams (2 to 4, inside words, with word ends) are hashed to buckets, each bucket has an embedding, a text is the
mean of the embeddings of its n-grams, and a linear softmax turns the mean into probabilities. Embeddings and softmax are
trained together by stochastic gradient descent in numpy on a bounded sample. As the model is linear up to the softmax, a
prediction only adds up bucket scores (embedding times softmax weights).

Calibration uses a fold that trains nothing. Its texts and their first words are scored; a temperature, higher for texts of
few n-grams, makes the probabilities honest. Texts are rejected for two reasons: a probability below a low quantile of those
of right answers, or too many n-grams that training never met. The limit of the latter lies half way between what texts of the
fold have, as a rule, and what the same texts have with their letters shuffled.

What the driver gets is a bounded sample: about ``max_sample`` rows of the ``max_langs`` commonest languages, fewer where
texts are long, so that their lengths add up to about ``max_chars``; a few times over for the calibration fold. Which rows
these are depends on hashes alone, and training, calibration and prediction use whole texts and all their n-grams.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text when nothing could
be learned. Rows with a null language train nothing. Repeated rows are predicted alike. Extra columns pass through; columns
of the input that carry an output's name are replaced.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwarden.llm.common import positional, schema_with, small_batches, table

UNKNOWN = "und"
OUTPUTS = ("held_out", "lang_pred", "score", "rejected")


@dataclass(frozen=True)
class LangIdConfig:
    buckets: int = 1 << 16
    dim: int = 16
    #: Passes over the sample, and the steps that a small sample gets at least.
    epochs: int = 6
    least_steps: int = 6000
    rate: float = 0.4
    #: Bounds of the training sample: languages, documents of each and of all, and the characters of all their texts (a text
    #: has no more different n-grams than buckets, so it counts for no more characters than that).
    max_langs: int = 1000
    per_lang: int = 1200
    max_sample: int = 12_000
    max_chars: int = 40_000_000
    #: Share of right calibration answers that the rejection may lose.
    reject_quantile: float = 0.001
    reject_cap: float = 0.5
    #: Word counts of the short pieces of a calibration text.
    pieces: tuple[int, ...] = (1, 3, 10)
    #: Every so many calibration texts one is shuffled.
    junk_every: int = 4
    #: Characters handled at once, and what is left of the last word: this bounds memory on very long texts.
    chunk: int = 1 << 20
    seed: int = 7


@dataclass(frozen=True)
class LangIdModel:
    langs: tuple[str, ...]
    scores: np.ndarray  # bucket x language: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    brevity: float  # n-grams at which the temperature is twice as high
    reject_below: float
    known: np.ndarray  # buckets that training met
    known_below: float
    config: LangIdConfig


@functools.cache
def _fold() -> np.ndarray:
    """Code point to lower-case letter, or to a space where there is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            out[c] = ord(s.lower()[0])
    return out


def _chunks(text: str, size: int) -> Iterator[str]:
    """A text in parts of some ``size`` characters, cut where no letter follows, so never inside a word."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def subword_buckets(text: str, config: LangIdConfig) -> Iterator[np.ndarray]:
    """Bucket numbers of all character n-grams of ``text``, chunk by chunk; nothing for a text without a letter."""
    for part in _chunks(text, config.chunk):
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        letters = _fold()[np.minimum(points, 0x10FFFF)]
        padded = np.concatenate(([np.uint32(32)], letters, [np.uint32(32)]))
        gap = padded == 32
        s = padded[~gap | np.concatenate(([True], ~gap[:-1]))]
        if len(s) < 3:
            continue
        inner = s != 32
        h2 = s[:-1] * np.uint32(0x01000193) + s[1:]
        h3 = h2[:-1] * np.uint32(0x01000193) + s[2:]
        h4 = h3[:-1] * np.uint32(0x01000193) + s[3:]
        grams = np.concatenate((h2, h3[inner[1:-1]] ^ np.uint32(0x5BD1E995), h4[inner[1:-2] & inner[2:-1]] ^ np.uint32(0x27D4EB2F)))
        grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        yield (grams ^ (grams >> np.uint32(13))) % np.uint32(config.buckets)


def text_features(text: str, config: LangIdConfig) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    counts = np.zeros(config.buckets, np.int64)
    for grams in subword_buckets(text, config):
        counts += np.bincount(grams, minlength=config.buckets)
    index = np.flatnonzero(counts)
    return index.astype(np.int32), (counts[index] / max(1, counts.sum())).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 0 modulo 5; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _features(text: str, config: LangIdConfig) -> tuple[bytes, bytes, int]:
    """The text's buckets and their shares, as bytes, and its number of n-grams."""
    index, share = text_features(text, config)
    return index.astype(_index_type(config)).tobytes(), share.tobytes(), sum(map(len, subword_buckets(text, config)))


def _index_type(config: LangIdConfig) -> type:
    return np.uint16 if config.buckets <= 1 << 16 else np.uint32


def _shuffled(text: str, config: LangIdConfig) -> str:
    """A text with its letters dealt out anew; other characters stay."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    places = np.flatnonzero(_fold()[np.minimum(points, 0x10FFFF)] != 32)
    points[places] = points[np.random.default_rng([config.seed, len(points)]).permutation(places)]
    return points.tobytes().decode("utf-32-le", "surrogatepass")


#: What a sampled row is: a text that trains, one of the calibration fold, its first words, or it with its letters shuffled.
TRAIN, WHOLE, PIECE, JUNK = range(4)


def _sample(docs: DataFrame, config: LangIdConfig) -> list:
    """Featurised rows ``(doc_id, lang, kind, index, share, n)``: about ``per_lang`` texts of a language, by a hash of the row; equal rows count once."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = usable.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.least(F.length("text"), F.lit(config.buckets))).alias("chars")).orderBy(F.desc("n"), "lang").limit(config.max_langs).collect()
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return []
    wanted = min(config.per_lang, config.max_sample / len(counts))
    fits = min(1.0, config.max_chars / max(1.0, sum(min(wanted, r["n"]) * r["chars"] for r in found)))
    shares = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, wanted / n) * fits))])
    small_batches(docs.sparkSession)
    drawn = usable.withColumn("h", F.xxhash64("doc_id", F.md5("text"), F.lit(config.seed))).where(F.pmod("h", F.lit(1 << 24)) < shares[F.col("lang")] * (1 << 24))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, lang, fold, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                text = text.as_py()
                rows.append((doc, lang, WHOLE if fold == 1 else TRAIN, *_features(text, config)))
                if fold == 1:
                    first = text.split(None, max(config.pieces))[: max(config.pieces)]
                    rows += [(doc, lang, PIECE, *_features(" ".join(first[:k]), config)) for k in config.pieces if k < len(first)]
                    if zlib.crc32(text.encode()) % config.junk_every == 0:
                        rows.append((doc, lang, JUNK, *_features(_shuffled(text, config), config)))
            types = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, types, strict=True)], ["doc_id", "lang", "kind", "index", "share", "n"])

    columns = drawn.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", (F.crc32(F.col("doc_id").cast("string")) % 5).cast("int").alias("fold"), "text")
    featurised = columns.mapInArrow(featurise, "doc_id long, lang string, kind int, index binary, share binary, n long").dropDuplicates()
    found = featurised.where(F.length("index") > 0).toArrow()  # in Arrow's buffers, which the arrays below look into
    index = (np.frombuffer(v.as_buffer(), _index_type(config)) for v in found["index"])
    share = (np.frombuffer(v.as_buffer(), np.float32) for v in found["share"])
    own = zip(*(found[k].to_pylist() for k in ("doc_id", "lang", "kind")), index, share, found["n"].to_pylist(), strict=True)
    return sorted(own, key=lambda r: (r[0], r[1], r[2], r[5], zlib.crc32(r[3]), zlib.crc32(r[4])))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(docs: DataFrame, config: LangIdConfig = LangIdConfig()) -> LangIdModel | None:
    """Train on ``docs(doc_id, text, lang)`` outside the held-out fold; None if no row can be learned from."""
    rows = _sample(docs, config)
    if not rows:
        return None
    langs = tuple(sorted({r[1] for r in rows}))
    code = {lang: k for k, lang in enumerate(langs)}
    whole = [r for r in rows if r[2] == WHOLE] or [r for r in rows if r[2] == TRAIN]
    calibration = [*whole, *(r for r in rows if r[2] == PIECE)]
    training = [r for r in rows if r[2] == TRAIN] or whole
    rng = np.random.default_rng(config.seed)
    embeddings = rng.uniform(-1 / config.dim, 1 / config.dim, (config.buckets, config.dim)).astype(np.float32)
    weights, bias = np.zeros((config.dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    epochs = max(config.epochs, -(-config.least_steps // len(training)))
    steps, step = epochs * len(training), 0
    for _ in range(epochs):
        for k in rng.permutation(len(training)):
            _, lang, _, index, share, _ = training[k]
            rate = np.float32(config.rate * (1 - step / steps))
            step += 1
            rows_of = embeddings[index]
            hidden = share @ rows_of
            gradient = _softmax(hidden @ weights + bias)
            gradient[code[lang]] -= 1
            back = weights @ gradient
            weights -= rate * np.outer(hidden, gradient)
            bias -= rate * gradient
            embeddings[index] = rows_of - (rate * len(index) ** 0.5) * share[:, None] * back[None, :]
    scores = (embeddings @ weights).astype(np.float32)
    logits = np.array([r[4] @ scores[r[3]] for r in calibration]) + bias
    truth, lengths = np.array([code[r[1]] for r in calibration]), np.array([r[5] for r in calibration])
    loss = {}
    for brevity in (0.0, *np.geomspace(2, 200, 9)):
        for t in np.geomspace(0.05, 20, 121):
            sure = _softmax(logits / (t * (1 + brevity / lengths))[:, None])
            loss[float(t), float(brevity)] = -np.log(np.maximum(sure[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature, brevity = min(loss, key=loss.__getitem__)
    sure = _softmax(logits / (temperature * (1 + brevity / lengths))[:, None])[: len(whole)]
    right = sure.argmax(axis=1) == truth[: len(whole)]
    limit = float(np.quantile(sure.max(axis=1)[right], config.reject_quantile)) if right.any() else 0.0
    known = np.zeros(config.buckets, np.bool_)
    for r in training:
        known[r[3]] = True
    share_known = lambda found: [float(r[4][known[r[3]]].sum()) for r in found]
    low = float(np.quantile(share_known(whole), config.reject_quantile))
    junk = share_known(r for r in rows if r[2] == JUNK)
    high = float(np.quantile(junk, 0.99)) if junk else 0.0
    return LangIdModel(langs, scores, bias.astype(np.float64), temperature, brevity, min(config.reject_cap, limit), known, (low + high) / 2 if high < low else 0.0, config)


def predict_text(model: LangIdModel, text: str | None) -> tuple[str, float, bool]:
    """Language and calibrated probability of one whole text, and whether it is rejected."""
    total, n, n_known = np.zeros(len(model.langs)), 0, 0
    for grams in subword_buckets(text or "", model.config):
        total += model.scores[grams].sum(axis=0, dtype=np.float64)
        n_known += int(model.known[grams].sum())
        n += len(grams)
    if not n:
        return UNKNOWN, 0.0, True
    sure = _softmax((total / n + model.bias) / (model.temperature * (1 + model.brevity / n)))
    k = int(sure.argmax())
    return model.langs[k], float(sure[k]), bool(sure[k] < model.reject_below or n_known < model.known_below * n)


def identify_language(docs: DataFrame, model: LangIdModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; only the column ``text`` is looked at."""
    small_batches(docs.sparkSession)
    kept = docs.drop(*OUTPUTS[1:])
    schema = schema_with(kept, "lang_pred string, score double, rejected boolean")
    names = [f.name for f in schema]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [predict_text(own, t.as_py()) if own else (UNKNOWN, 0.0, True) for t in batch.column(text)]
            extra = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names)

    return kept.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, config: LangIdConfig = LangIdConfig()) -> DataFrame:
    """Rows of ``docs`` whose language is known with enough certainty, columns unchanged."""
    plain, names = positional(docs)
    found = identify_language(plain, fit(docs, config), names["text"])
    return found.where(~F.col("rejected")).select(*plain.columns).toDF(*docs.columns)


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
