"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-case words (letters and digits; all else separates; in scripts without spaces each letter is a word). A fixed mask selects some positions of a short
stretch of words, and the selected words are hashed; a stretch that differs from a benchmark's only at ignored positions has
the same hash. Hashes of documents and benchmark items are joined; every hit names a diagonal (position in the document
minus position in the item), on which the words are compared one by one: a document is contaminated by an item if some
window of ``window`` words on the diagonal (the whole item, if that is shorter) agrees in at least ``agree`` of its words.
The three masks together hit every window of 13 words with at most two substitutions. An item shorter than the window has
masks of its length: cut into two groups of words more than it may have substitutions, the masks leave out as many groups as
there may be substitutions, in every way, so that one of them meets no substitution.

A Bloom filter of the benchmark's hashes keeps nearly all other hashes of documents from the join. It is made by grouped
aggregation, has at most ``2 ** filter_bits`` bits however large the benchmark is, and only lets more pass as it fills: every
hash that passes goes on to the join. Documents are hashed many at a time, very long ones in pieces, and pass on in segments
of bounded length, so no row holds a whole text.

Edge cases: null and empty texts hit nothing; an empty table on either side gives an empty result. Columns other than the id
and the text aren't looked at, and stay as they are in ``drop_contaminated``. Items of fewer than ``min_words`` words find only documents that have
the same words and no more; items without a word find nothing. A row without a ``doc_id`` is never reported, and stays. Repeated rows are reported once.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwarden.llm.common import letter_values, maybe_broadcast, mix64, run_hashes, small_batches, stored, table, whole_runs, without_ids


#: Benchmark texts of at most so many bytes of word ids are broadcast for the comparison.
ITEM_BYTES = 32 << 20


@dataclass(frozen=True)
class SeedConfig:
    masks: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 5, 6, 8), (0, 1, 2, 4, 7, 8, 9), (0, 3, 4, 5, 7, 8, 9))
    window: int = 13
    agree: float = 0.8
    min_words: int = 5
    segment: int = 256
    #: Bits of the filter: so many for each benchmark hash, and at most two to this power; and how many a hash has set.
    filter_share: int = 64
    filter_bits: int = 29
    probes: int = 4
    #: Characters that are hashed at once, which bounds memory on very long texts.
    chunk: int = 1 << 20
    seed: int = 3


#: Stands between two texts that are hashed together; inside a text it separates words, as other control characters do.
BREAK = "\x01"
#: Ranges of code points of scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


@functools.cache
def _values() -> np.ndarray:
    out = letter_values().copy()
    out[1] = 0x9E3779B97F4A7C15  # the break
    return out


def _unspaced(points: np.ndarray) -> np.ndarray | None:
    """Where the letters of scripts without spaces stand; None without any."""
    if not len(points) or points.max() < UNSPACED[0][0]:
        return None
    found = np.zeros(len(points), np.bool_)
    for low, high in UNSPACED:
        found |= (points >= low) & (points <= high)
    return found & (letter_values()[points] != 0)


def ids_of(texts: list[str | None], chunk: int) -> np.ndarray:
    """64-bit ids of the lower-case words of some texts, with the id of a break between two texts."""
    joined = f" {BREAK} ".join((t or "").replace(BREAK, " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    return whole_runs(points, _values(), chunk, _unspaced)


def words(text: str | None) -> np.ndarray:
    """64-bit ids of a text's lower-case words."""
    return ids_of([text], SeedConfig.chunk)


@functools.cache
def _break_id() -> int:
    return int(run_hashes(_values()[[1]])[0])


def short_masks(n: int, config: SeedConfig) -> tuple[tuple[int, ...], ...]:
    """Masks over an item of ``n`` words, one of which meets none of the substitutions that ``agree`` grants, wherever they are."""
    granted = n - math.ceil(config.agree * n - 1e-9)
    groups = [g.tolist() for g in np.array_split(np.arange(n), min(n, granted + 2))]
    return tuple(tuple(k for g in kept for k in g) for kept in combinations(groups, len(groups) - granted))


def masks_for(lengths: set[int], config: SeedConfig) -> tuple[tuple[int, ...], ...]:
    """The fixed masks, and those of each item length below the window."""
    return tuple(dict.fromkeys([*config.masks, *[m for n in sorted(lengths) if config.min_words <= n < config.window for m in short_masks(n, config)]]))


def whole_key(ids: np.ndarray, config: SeedConfig) -> np.ndarray:
    """One hash of a text of fewer than ``min_words`` words, unlike that of any mask; none of other texts."""
    n = len(ids)
    return mix64(seed_keys(ids, tuple(range(n)), config) ^ np.uint64(n)) if 0 < n < config.min_words else np.zeros(0, np.uint64)


@functools.cache
def _factors(seed: int) -> np.ndarray:
    """An odd factor for each position of a mask."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mask_keys(ids: np.ndarray, masks: tuple[tuple[int, ...], ...], config: SeedConfig) -> list[np.ndarray]:
    """For each mask its hash at each position at which it fits; products of words and factors are shared by the masks."""
    products: dict[int, np.ndarray] = {}
    out = []
    for mask in masks:
        n = len(ids) - mask[-1]
        if n <= 0:
            out.append(np.zeros(0, np.uint64))
            continue
        salt = np.uint64(zlib.crc32(repr(mask).encode()))
        total = None
        for at in mask:
            if at not in products:
                products[at] = ids * _factors(config.seed)[at]
            total = products[at][at : at + n] + salt if total is None else np.add(total, products[at][at : at + n], out=total)
        out.append(total)
    return out


def seed_keys(ids: np.ndarray, mask: tuple[int, ...], config: SeedConfig) -> np.ndarray:
    """Hash of one mask at each position of a text at which it fits."""
    return mask_keys(ids, (mask,), config)[0]


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, config: SeedConfig) -> tuple[int, int, int] | None:
    """First and last word (exclusive) in ``doc`` of the windows that agree, and the equal words between; None without any."""
    start, end = max(0, diagonal), min(len(doc), diagonal + len(item))
    width = min(config.window, len(item))
    if end - start < width:
        return None
    same = np.concatenate(([0], np.cumsum(doc[start:end] == item[start - diagonal : end - diagonal])))
    good = np.flatnonzero(same[width:] - same[:-width] >= config.agree * width)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + width
    return start + first, start + last, int(same[last] - same[first])


def benchmark_items(benchmark: DataFrame, config: SeedConfig) -> DataFrame:
    """``(item_id, tokens)`` of the items with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [words(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int64()))], ["item_id", "tokens"])

    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return items.mapInArrow(run, "item_id long, tokens array<long>").where(F.size("tokens") > 0).dropDuplicates()


def _seeds(items: DataFrame, config: SeedConfig) -> DataFrame:
    """``(key, item_id, at)`` of every fixed mask at every position of every item; of items shorter than the window, of their own masks and place 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, ats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for item, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.array(tokens.values, np.int64).view(np.uint64)
                if len(own) < config.min_words:
                    each = [whole_key(own, config)]
                elif len(own) < config.window:
                    each = [seed_keys(own, mask, config)[:1] for mask in short_masks(len(own), config)]
                else:
                    each = [seed_keys(own, mask, config) for mask in config.masks]
                for found in each:
                    keys.append(found.view(np.int64))
                    ids.append(np.full(len(found), item, np.int64))
                    ats.append(np.arange(len(found), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, ats)], ["key", "item_id", "at"])

    return items.mapInArrow(run, "key long, item_id long, at int")


def _probes(keys: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The bit of the filter that the ``k``-th probe of each key looks at."""
    return (keys if k == 0 else mix64(keys + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) >> np.uint64(64 - bits)


def key_filter(seeds: DataFrame, n: int, config: SeedConfig) -> np.ndarray:
    """A Bloom filter of the keys as bits, 64 to a number; made of grouped parts of at most ``2 ** filter_bits`` bits in all."""
    bits = min(config.filter_bits, max(6, (config.filter_share * max(1, n)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_probes(keys, bits, k) for k in range(config.probes)]))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["place", "bits"])

    parts = seeds.select("key").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[parts.column("place").to_numpy()] = parts.column("bits").to_numpy()
    return out.view(np.uint64)


def matches(found: np.ndarray, known: np.ndarray, config: SeedConfig) -> np.ndarray:
    """Places of ``found`` whose key the filter lets pass."""
    bits, at = len(known).bit_length() + 5, np.arange(len(found))
    for k in range(config.probes):
        probe = _probes(found if k == 0 else found[at], bits, k)
        at = at[(known[probe >> np.uint64(6)] >> (probe & np.uint64(63)) & np.uint64(1)).astype(np.bool_)]
    return at


def _segments(docs: DataFrame, masks: tuple[tuple[int, ...], ...], known: np.ndarray, config: SeedConfig) -> DataFrame:
    """Stretches of documents with a hit: words with enough context on both sides, and the hits."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    context, span = config.window - 1, max(m[-1] for m in masks) + 1

    def hits(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the masks that lie in one text and pass the filter."""
        places, keys = [], []
        for mask, found in zip(masks, mask_keys(ids, masks, config), strict=True):
            at = matches(found, shared.value, config)
            at = at[owner[at] == owner[at + mask[-1]]]
            places.append(at)
            keys.append(found[at])
        return np.concatenate(places), np.concatenate(keys)

    def rows(doc: int, ids: np.ndarray, place: np.ndarray, key: np.ndarray) -> Iterator[tuple]:
        import xxhash

        for k in np.unique(place // config.segment).tolist():
            own = place // config.segment == k
            start = max(0, k * config.segment - context)
            stretch = ids[start : (k + 1) * config.segment + span + context]
            row = (xxhash.xxh3_64_intdigest(stretch.tobytes(), doc & (1 << 64) - 1) ^ start) - (1 << 63)
            yield row, doc, start, stretch.view(np.int64), (place[own] - start).astype(np.int32), key[own].view(np.int64)

    def together(group: list[tuple[int, str]]) -> Iterator[tuple]:
        """Rows of some texts that are hashed as one, with a break between."""
        ids = ids_of([text for _, text in group], config.chunk)
        breaks = ids == np.uint64(_break_id())
        owner, bounds = np.cumsum(breaks), np.concatenate(([-1], np.flatnonzero(breaks), [len(ids)]))
        place, key = hits(ids, owner)
        found = owner[place]
        short = np.flatnonzero(np.diff(bounds) <= config.min_words)
        for k in np.union1d(found, short).tolist():
            own, start = ids[bounds[k] + 1 : bounds[k + 1]], bounds[k] + 1
            of = found == k
            at, keys = place[of] - start, key[of]
            whole = whole_key(own, config)
            pass_ = matches(whole, shared.value, config)
            at, keys = np.concatenate([at, pass_]), np.concatenate([keys, whole[pass_]])
            inside = at >= 0  # a mask that begins at the break itself belongs to no text
            yield from rows(group[k][0], own, at[inside], keys[inside])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            group, size, left = [], 0, batch.num_rows
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                group.append((doc, text.as_py()))
                size, left = size + len(group[-1][1]), left - 1
                if size > config.chunk or not left:
                    out = list(zip(*together(group), strict=True)) or [[]] * len(types)
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["seg", "doc_id", "start", "tokens", "places", "keys"])
                    group, size = [], 0

    small_batches(docs.sparkSession)
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(run, "seg long, doc_id long, start int, tokens array<long>, places array<int>, keys array<long>")


def contaminations(docs: DataFrame, benchmark: DataFrame, config: SeedConfig = SeedConfig()) -> DataFrame:
    """``(doc_id, item_id, doc_start, doc_end, n_equal)``: each document and item that overlap, in words of the document."""
    spark = docs.sparkSession
    small_batches(spark)
    items = stored(benchmark_items(benchmark, config), "items")
    lengths = {r[0] for r in items.select(F.size("tokens")).where(F.size("tokens") < config.window).distinct().collect()}
    masks = masks_for(lengths, config)
    seeds = stored(_seeds(items, config), "seeds")
    n = seeds.count()
    item_bytes = items.agg(F.coalesce(F.sum(8 * F.size("tokens") + 16), F.lit(0))).first()[0]
    segment = ["doc_id", "start", "seg"]
    segments = stored(_segments(docs, masks, key_filter(seeds, n, config), config), "segments").dropDuplicates(segment)
    hits = segments.select(*segment, F.explode(F.arrays_zip("places", "keys")).alias("h")).select(*segment, "h.places", F.col("h.keys").alias("key"))
    diagonals = hits.join(maybe_broadcast(seeds, n), "key").select(*segment, "item_id", (F.col("places") - F.col("at")).alias("diagonal")).distinct()
    pairs = diagonals.join(segments.select(*segment, "tokens"), segment).join(maybe_broadcast(items.withColumnRenamed("tokens", "item"), item_bytes, ITEM_BYTES), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, item, start, diagonal, tokens, other in zip(*[batch.column(k).to_pylist() for k in range(4)], batch.column(4), batch.column(5), strict=True):
                if found := overlap(np.array(tokens.values), np.array(other.values), diagonal, config):
                    rows.append((doc, item, start + found[0], start + found[1], found[2]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "item_id", "doc_start", "doc_end", "n_equal"])

    found = pairs.select("doc_id", "item_id", "start", "diagonal", "tokens", "item").mapInArrow(verify, "doc_id long, item_id long, doc_start long, doc_end long, n_equal long")
    return found.groupBy("doc_id", "item_id").agg(F.min("doc_start").alias("doc_start"), F.max("doc_end").alias("doc_end"), F.max("n_equal").alias("n_equal"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, config: SeedConfig = SeedConfig()) -> DataFrame:
    """``docs`` without the contaminated documents; columns unchanged."""
    found = contaminations(docs.select("doc_id", "text"), benchmark, config)
    return without_ids(docs, stored(found.select("doc_id").distinct(), "contaminated"))


def op3_decontam(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminations(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
