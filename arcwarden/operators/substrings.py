"""Which of many patterns stand inside texts, found by joins.

A pattern is known by one of its n-grams, its anchor: itself if it isn't longer than the widest kind, else of this kind the one that
fewest patterns have. Texts send the hashes of their n-grams, of each width that anchors have, to a join with the anchors, and get back
the patterns that may stand in them: short ones only where they do; whoever uses these looks at the text itself. A sieve of bounded size,
which all tasks have, keeps most n-grams that are no anchor from being sent: a place of a text is given up as soon as no anchor starts like it. A common start of many patterns is never an anchor as long as their ends
differ, so a text gets few patterns that it doesn't hold. Patterns are a table of any size: it is broadcast only if it is small.

Edge cases: patterns of fewer characters than the least width, and null ones, aren't looked for; null and shorter texts hold
none. Repeated patterns count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwarden.tables import small, stored

#: Least and largest width of n-grams; patterns of fewer characters than the least aren't looked for inside texts.
WIDTHS = (4, 16)
#: Widths with which any pattern of a character or more is found.
ALL_WIDTHS = (1, 16)


#: Characters of a text that are cut into n-grams at once, and hashes of one Arrow batch, at least.
CHUNK, BATCH = 1 << 16, 1 << 18


def text_hash(s: str, seed: int = 42) -> int:
    """A string's hash; with this seed the same as Spark's ``xxhash64``."""
    import xxhash

    h = xxhash.xxh64_intdigest(s, seed)
    return h - (1 << 64) if h >> 63 else h


# Odd multipliers of the n-grams' hashes, modulo 2 ** 64.
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams_of(s: str, widths: Sequence[int]) -> dict[int, np.ndarray]:
    """Hashes of the n-grams of each width, one for each place."""
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    out, h = {}, np.zeros(len(codes), np.uint64)
    for n in range(1, min(max(widths, default=0), len(codes)) + 1):
        h = h[: len(codes) - n + 1] * _BASE + codes[n - 1 :]
        if n in widths:
            out[n] = _mixed(h, n).view(np.int64)
    return out


def gram_hashes(s: str, width: int) -> list[int]:
    """The same for one width."""
    return grams_of(s, (width,)).get(width, np.empty(0, np.int64)).tolist()


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * _MIX + np.uint64(n)


#: Widths of the anchors' starts that a sieve holds, the largest number of its bits, and its bits for each hash.
LEVELS, SIEVE_BITS, SIEVE_SHARE = (4, 6, 8, 12), 28, 16
# Fixed value: sets the hashes of starts apart from those of anchors.
_START = np.uint64(0xA24BAED4963EE407)


def _bits_at(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return ((keys * _BASE if probe else keys) >> np.uint64(64 - bits)).view(np.int64)


def passing(keys: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Places of the keys that the sieve may hold."""
    bits, at = (8 * len(sieve)).bit_length() - 1, np.arange(0)
    for probe in (0, 1):
        bit = _bits_at(keys[at] if probe else keys, bits, probe)
        held = np.flatnonzero(sieve[bit >> 3] >> (bit & 7).astype(np.uint8) & np.uint8(1))
        at = at[held] if probe else held
    return at


def sieve_of(anchors: DataFrame, entries: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes of ``entries(h)`` and of the starts of ``anchors(gram)``, both stored.

    It is made of grouped parts of at most ``2 ** SIEVE_BITS`` bits in all, however many hashes there are; as it fills it only lets more pass.
    """
    n = entries.count() + len(LEVELS) * anchors.count()
    bits = min(SIEVE_BITS, max(12, (SIEVE_SHARE * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = [h.view(np.uint64) ^ _START for s in batch.column(1).to_pylist() if s for n, h in grams_of(s[: LEVELS[-1]], LEVELS).items() for h in [h[:1]]]
            keys = np.concatenate([batch.column(0).drop_null().to_numpy().view(np.uint64), *starts])
            at = np.unique(np.concatenate([_bits_at(keys, bits, probe) for probe in (0, 1)]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).view(np.uint64)).view(np.int64))], ["place", "bits"])

    null = F.lit(None)
    keys = entries.select("h", null.cast("string").alias("gram")).unionByName(anchors.select(null.cast("long").alias("h"), "gram"))
    parts = keys.mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, "<i8")
    out[parts.column("place").to_numpy()] = parts.column("bits").to_numpy()
    return out.view(np.uint8)


def _places(codes: np.ndarray, widths: Sequence[int], sieve: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the n-grams of each width that the sieve lets pass; at places of which no anchor starts like them longer ones aren't looked at."""
    padded = np.concatenate([codes, np.zeros(max(widths), np.uint64)])
    at, h = None, np.zeros(len(codes), np.uint64)
    for n in range(1, max(widths) + 1):
        h = h * _BASE + (padded[n - 1 : n - 1 + len(codes)] if at is None else padded[at + (n - 1)])
        if sieve is not None and n in LEVELS:
            kept = passing(_mixed(h, n) ^ _START, sieve)
            at, h = kept if at is None else at[kept], h[kept]
            if not len(at):
                return
        if n in widths:
            keys = _mixed(h, n)
            held = np.arange(len(keys)) if sieve is None else passing(keys, sieve)
            yield held if at is None else at[held], keys[held].view(np.int64)


def _once(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def sent_grams(rows: Iterable[tuple[int, list[str]]], widths: Sequence[int], sieve: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """``(_row, h)`` of rows with their texts: hashes of n-grams, and of each text as a whole without the blanks around it; with a sieve, those that it lets pass.

    Texts are cut many at a time, with a character between them, and long ones in pieces.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    pieces: list[tuple[int, str]] = []
    wholes: list[tuple[int, int]] = []
    chars = n = 0

    def cut() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        whole = np.array(wholes, np.int64).reshape(-1, 2)
        yield from [(whole[:, 0], whole[:, 1])] if sieve is None else [(whole[k, 0], whole[k, 1]) for k in [passing(whole[:, 1].copy().view(np.uint64), sieve)]]
        if pieces and widths:
            codes = np.frombuffer("\0".join(s for _, s in pieces).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
            ends, of = np.cumsum([len(s) + 1 for _, s in pieces]), np.array([r for r, _ in pieces], np.int64)
            for at, hashes in _places(codes, widths, sieve):
                yield of[np.searchsorted(ends, at, "right")], hashes

    def batch() -> pa.RecordBatch:
        of, hashes = (np.concatenate([x[k] for x in held]) if held else np.empty(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array(hashes)], ["_row", "h"])

    def found() -> None:
        nonlocal chars, n
        rows_of, hashes = zip(*cut(), strict=True)
        held.append(_once(np.concatenate(rows_of), np.concatenate(hashes)))
        n += len(held[-1][0])
        pieces.clear()
        wholes.clear()
        chars = 0

    for row, texts in rows:
        for s in texts:
            wholes.append((row, text_hash(s.strip())))
            if len(wholes) >= CHUNK:
                found()
            for at in range(0, len(s) if widths else 0, CHUNK):
                pieces.append((row, s[at : at + CHUNK + max(widths) - 1]))
                chars += len(pieces[-1][1])
                if chars >= CHUNK:
                    found()
                if n >= BATCH:
                    yield batch()
                    held.clear()
                    n = 0
    found()
    yield batch()


def widths_of(anchors: DataFrame) -> list[int]:
    """The widths that anchors have; the driver gets no more of them than the largest one."""
    return sorted(r["width"] for r in anchors.select("width").distinct().collect())


def anchored(patterns: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``(pattern, h, width, gram)``: each pattern of ``patterns(pattern)`` with the hash and width of its anchor, and the anchor, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, places, hashes = [], [], []
            for s in batch.column(0).to_pylist():
                own = gram_hashes(s, min(len(s), widths[-1]))
                names += [s] * len(own)
                places += range(len(own))
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(hashes, pa.int64())], ["pattern", "at", "h"])

    long_enough = patterns.select("pattern").where(F.length("pattern") >= widths[0]).distinct()
    grams = stored(long_enough.mapInArrow(run, "pattern string, at int, h long"), "grams")
    counts = grams.groupBy("h").agg(F.count_distinct("pattern").alias("n"))
    best = grams.join(counts, "h").groupBy("pattern").agg(F.min(F.struct("n", "at", "h")).alias("best"))
    width = F.least(F.length("pattern"), F.lit(widths[-1]))
    return stored(best.select("pattern", F.col("best.h").alias("h"), width.alias("width"), F.substring("pattern", F.col("best.at") + 1, width).alias("gram")), "anchors")


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(text, pattern)`` of the distinct ``texts(text)``, which should be short, that hold a pattern of one character or more.

    A join by equality of hashes, and a look at what it brings. The driver gets the widths that anchors have.
    """
    anchors = anchored(patterns, ALL_WIDTHS)
    used = widths_of(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                held = {h for found in grams_of(s, used).values() for h in found.tolist()}
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(held), pa.string()), pa.array(list(held), pa.int64())], ["text", "h"])

    sent = texts.select("text").where("text is not null").distinct().mapInArrow(run, "text string, h long")
    return sent.join(small(anchors.select("pattern", "h")), "h").where(F.contains("text", "pattern")).select("text", "pattern").distinct()


def replaced(s: str, pairs: dict[str, str]) -> str:
    """``s`` with the keys of ``pairs`` replaced wherever they stand, longer ones first; what has been put in is left alone."""
    parts = [(s, False)]
    for real in sorted(pairs, key=lambda r: (-len(r), r)):
        if real not in s:
            continue
        out: list[tuple[str, bool]] = []
        for part, done in parts:
            if done or real not in part:
                out.append((part, done))
                continue
            first, *rest = part.split(real)
            out.append((first, False))
            for piece in rest:
                out += [(pairs[real], True), (piece, False)]
        parts = out
    return "".join(p for p, _ in parts)
