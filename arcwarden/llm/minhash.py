"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct word shingles, hashed to 64 bits. The hashes' leading bits deal them to bins, the least hash
of a bin is its value, and an empty bin borrows from the first filled bin of its own random probe sequence. Bands of bins
give bucket keys. Work then goes from cheap to exact:

1. documents with equal sets form a class (one grouped aggregation), and only its smallest ``doc_id`` goes on;
2. in each bucket every member is paired with one centre, the member that shares most buckets with others (in a family of
   edited copies that is the original, as a rule): a star, so pairs grow as members do;
3. star pairs are confirmed on the full shingle sets, and confirmed links give components;
4. where a bucket still holds several components, the best member outside its commonest component becomes the centre of a
   new star over the other components, again and again until no star brings a link; pairs of the round before aren't asked anew;
5. where a bucket holds several components even then, the members outside its commonest component meet the others in blocks
   of bounded size; a bucket with but one such member is done, as its last star was all of its pairs. A pair is looked at in the first band that it shares; if its sketches agree in nearly as many bins as
   the threshold asks for, and so do the least hashes of both sets (all of them, for sets of up to ``low``), it is confirmed
   on full sets as well. So a block hands on links, and few pairs besides, however many rows a bucket has.

Pairs inside a component need no test, as they can't change it, so no link between components is lost to the stars. With 32
bands of 4 bins, a pair at the threshold of 0.8 shares no band about once in 20 million pairs. The sketches of such a pair
agree in fewer bins than ``least_agreement`` allows, or its least hashes in less than ``low_agree``, less than once in a
million; small sets, whose sketches say little, are told by their hashes alone.

Edge cases: a text without words has the empty set and links with nothing; one of fewer words than a shingle is one shingle.
A row without a ``doc_id`` links with nothing, has a null component and is kept. Repeated rows get the same answer.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwarden.llm.common import BROADCAST_ROWS, byte_word_ids, maybe_broadcast, mix64, small_batches, stored, table, without_ids
from arcwarden.llm.components import components, joined


@dataclass(frozen=True)
class MinHashConfig:
    width: int = 4
    #: Percent of the union that the intersection must reach.
    threshold: int = 80
    bands: int = 32
    band_bins: int = 4
    #: Members of one block in the residual comparison, the standard deviations by which a pair's sketches may agree less than
    #: the threshold there, the least hashes looked at, and the similarity that they must have where they aren't the whole sets.
    block: int = 512
    deviations: float = 5.0
    low: int = 512
    low_agree: float = 0.7
    seed: int = 11

    @property
    def bins(self) -> int:
        return self.bands * self.band_bins


@functools.cache
def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def _probes(bins: int, seed: int, tries: int = 4096) -> np.ndarray:
    """For each bin the order in which it looks for a filled one."""
    return np.random.default_rng(seed + 1).integers(0, bins, (tries, bins), dtype=np.int64)


def shingle_set(text: bytes | None, config: MinHashConfig) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    ids, odd = byte_word_ids(text or b""), _odd(max(config.width, 8), config.seed)
    if not len(ids):
        return np.zeros(0, np.uint64)
    if len(ids) < config.width:
        return mix64((ids * odd[: len(ids)]).sum(keepdims=True) + np.uint64(len(ids)))
    n = len(ids) - config.width + 1
    total = ids[:n] * odd[0]
    for k in range(1, config.width):
        total = total + ids[k : k + n] * odd[k]
    return np.unique(mix64(total))


def sketch(shingles: np.ndarray, config: MinHashConfig) -> np.ndarray:
    """Sixteen bits of each bin's value of a non-empty sorted set, the bins of a band side by side in one 64-bit number."""
    bins, shift = config.bins, np.uint64(64 - (config.bins - 1).bit_length())
    starts = np.searchsorted(shingles >> shift, np.arange(bins + 1, dtype=np.uint64))
    filled = starts[:-1] < starts[1:]
    source = np.arange(bins)
    empty = np.flatnonzero(~filled)
    probes = _probes(bins, config.seed)
    at = 0
    for tries in (32, 480, len(probes)):
        if not len(empty):
            break
        looked = probes[at:tries, empty]
        hits = filled[looked]
        first, found = hits.argmax(axis=0), hits.any(axis=0)
        source[empty[found]] = looked[first[found], np.flatnonzero(found)]
        empty, at = empty[~found], tries
    if len(empty):
        source[empty] = np.flatnonzero(filled)[0]
    return mix64(shingles[starts[:-1][source]]).astype(np.uint16).view(np.int64)


def signatures(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """``(doc_id, n_shingles, set_key, keys)`` of every row: the bucket keys of the sketch's bands; null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, buckets = [], [], []
            for value in batch.column(1).cast(pa.binary()):
                found = shingle_set(value.as_py(), config)
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                buckets.append(bucket_keys(sketch(found, config)) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "keys"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, keys array<long>")


def _once(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row for each ``doc_id``; only rows of the ids in the stored table ``repeated``, which several rows have, are moved."""
    if not repeated.limit(1).count():
        return rows
    ids = maybe_broadcast(repeated)
    return rows.join(ids, "doc_id", "left_anti").unionByName(rows.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def full_sets(docs: DataFrame, ids: DataFrame, repeated: DataFrame, config: MinHashConfig) -> DataFrame:
    """``(doc_id, n, shingles, bands)`` of the documents named in the stored table ``ids``: the set, its size, and its sketch by band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(v.as_py(), config).view(np.int64) for v in batch.column(1).cast(pa.binary())]
            sizes, longs = pa.array([len(s) for s in sets], pa.int64()), pa.list_(pa.int64())
            bands = [sketch(s.view(np.uint64), config) if len(s) else np.zeros(config.bands, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(sets, longs), pa.array(bands, longs)], ["doc_id", "n", "shingles", "bands"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(maybe_broadcast(ids), "doc_id", "left_semi")
    return _once(wanted, repeated).mapInArrow(run, "doc_id long, n long, shingles array<long>, bands array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, config: MinHashConfig) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough.

    Pairs of too different sizes go before any set moves, and only sets that the others name do, as long as their ids may be broadcast.
    """
    near = 100 * F.least("na", "nb") >= config.threshold * F.greatest("na", "nb")
    sizes = sets.select("doc_id", "n")
    n = sizes.count()
    sized = pairs.select("a", "b")
    for end in ("a", "b"):
        sized = sized.join(maybe_broadcast(sizes.select(F.col("doc_id").alias(end), F.col("n").alias(f"n{end}")), n), end)
    left_over = stored(sized.where(near), "pairs")
    sides = []
    for end in ("a", "b"):
        side = sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(f"s{end}"))
        named = stored(left_over.select(end).distinct(), "named")
        few = named.count()
        sides.append(side.join(F.broadcast(named), end, "left_semi") if few <= min(BROADCAST_ROWS, n // 2) else side)
    both = F.size(F.array_intersect("sa", "sb"))
    return left_over.join(sides[1], "b").join(sides[0], "a").where(100 * both >= config.threshold * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _several(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components: key, doc_id, score, label, and the bucket's main label, size, and size of the main."""
    named = members.join(maybe_broadcast(labels.where("node != component").withColumnRenamed("node", "doc_id")), "doc_id", "left").select("key", "doc_id", "score", F.coalesce("component", "doc_id").alias("label"))
    counts = named.groupBy("key", "label").agg(F.count("*").alias("m"))
    buckets = counts.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    return stored(named.join(maybe_broadcast(stored(buckets, "buckets")), "key"), "several")


def _star(several: DataFrame) -> DataFrame:
    """Pairs of the best member outside the main component with all members of other components."""
    best = several.where("label != main").groupBy("key").agg(F.max(F.struct("score", -F.col("doc_id"), F.col("label").alias("of"))).alias("c"))
    pairs = several.select("key", "doc_id", "label").join(maybe_broadcast(stored(best, "best")), "key").where(F.col("label") != F.col("c.of"))
    return pairs.select(F.least("doc_id", -F.col("c.col2")).alias("a"), F.greatest("doc_id", -F.col("c.col2")).alias("b")).distinct()


def low_similarity(a: np.ndarray, b: np.ndarray, low: int) -> tuple[float, bool]:
    """Similarity of two sets by their least hashes (sorted), and whether these were the whole sets."""
    whole = len(a) < low and len(b) < low
    if not whole:
        end = min(a[-1] if len(a) == low else b[-1], b[-1] if len(b) == low else a[-1])
        a, b = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
    return both / max(1, len(a) + len(b) - both), whole


def least_agreement(sizes: np.ndarray, config: MinHashConfig) -> np.ndarray:
    """Bins that the sketches of a similar pair agree in at least, by the size of the larger set; 0 for sets that fill less than an eighth of the bins.

    A sketch looks at no more elements than bins or set has, and empty bins repeat some of them, which counts as a quarter fewer.
    """
    t = config.threshold / 100
    looked = np.maximum(1, 0.75 * np.minimum(config.bins, sizes))
    least = np.maximum(0, np.ceil(config.bins * (t - config.deviations * np.sqrt(t * (1 - t) / looked))))
    return np.where(8 * np.asarray(sizes) < config.bins, 0.0, least)


def _block_pairs(several: DataFrame, sets: DataFrame, config: MinHashConfig) -> DataFrame:
    """Pairs of one bucket in different components whose sketches agree well enough.

    Members of a bucket's main component stand on the right side only (1); all others stand on the left (0), and on the right too,
    where a bucket is one block by the same row (2). Both sides are dealt to blocks, and every block of the left meets every block
    of the right in a group of its own. A bucket with one member outside the main component has no pair but those of its star.
    """
    several = several.where(F.col("all") - F.col("most") > 1)
    blocks = lambda n: F.ceil(n / config.block).cast("int")
    lefts, rights = blocks(F.col("all") - F.col("most")), blocks(F.col("all"))
    spread = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    whole = rights == 1
    left = several.where("label != main").select("key", "doc_id", "label", F.when(whole, 2).otherwise(0).alias("side"), spread(lefts, 1).alias("i"), every(rights).alias("j"))
    right = several.where(~whole | (F.col("label") == F.col("main"))).select("key", "doc_id", "label", F.lit(1).alias("side"), every(lefts).alias("i"), spread(rights, 2).alias("j"))
    least_hashes = F.transform(F.slice("shingles", 1, config.low), lambda x: F.shiftrightunsigned(x, 32))
    asked = stored(several.select("doc_id").distinct(), "asked")
    shapes = sets.select("doc_id", "bands", least_hashes.alias("lows")).join(maybe_broadcast(asked), "doc_id", "left_semi")
    placed = left.unionByName(right).join(shapes, "doc_id")
    dealt = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "side", "doc_id", "label", "bands", "lows")
    def compare(t: pa.Table) -> np.ndarray:
        side, ids, label = (t.column(c).to_numpy() for c in ("side", "doc_id", "label"))
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        key, bins = t.column("key")[0].as_py(), bands.view(np.uint16)
        flat = t.column("lows").combine_chunks()
        sizes, lows = flat.value_lengths().to_numpy(), flat.flatten().to_numpy()
        ends = sizes.cumsum()
        low = lambda n: lows[ends[n - 1] if n else 0 : ends[n]]
        right, found = np.flatnonzero(side != 0), [np.zeros((0, 2), np.int64)]
        for k in np.flatnonzero(side != 1):
            least = least_agreement(np.maximum(sizes[right], sizes[k]), config)
            near = right[((bins[right] == bins[k]).sum(axis=1) >= least) & (label[right] != label[k])]
            if len(near):
                near = near[_first_key(bands[near], bands[k]) == key]
                own = low(k)
                alike = [low_similarity(own, low(n), config.low) for n in near]
                near = near[np.array([x >= (config.threshold / 100 - 1e-9 if whole else config.low_agree) for x, whole in alike], np.bool_)]
                found.append(np.stack([np.minimum(ids[near], ids[k]), np.maximum(ids[near], ids[k])], axis=1))
        return np.concatenate(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.concat_tables([*([] if rest is None else [rest]), pa.Table.from_batches([batch])])
            k, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
            bounds = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()]
            rest = t.slice(bounds[-1])  # the last group may go on
            pairs = [compare(t.slice(s, e - s)) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            if pairs and len(found := np.concatenate(pairs)):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
        if rest is not None and rest.num_rows and len(found := compare(rest)):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    small_batches(placed.sparkSession)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def bucket_keys(bands: np.ndarray) -> np.ndarray:
    """Bucket keys of sketches: each band with its number."""
    return mix64(bands.view(np.uint64) + _odd(bands.shape[-1], 29)).view(np.int64)


def _first_key(others: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The key of the first band that each of ``others`` shares with ``own``."""
    return bucket_keys(own)[(others == own).argmax(axis=1)]


def near_duplicates(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``."""
    signed = stored(signatures(docs, config), "signatures")
    usable = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    repeated = stored(usable.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    classes = stored(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("set_key", "rep"), "classes")
    classed = signed.join(maybe_broadcast(classes), "set_key", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    reps = stored(_once(classed.where(F.col("set_key").isNotNull() & (F.col("doc_id") == F.col("rep"))).select("doc_id", "keys"), repeated), "reps")
    keyed = reps.select("doc_id", F.explode("keys").alias("key"))
    buckets = stored(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    shared = stored(keyed.join(maybe_broadcast(buckets), "key"), "shared")
    scores = stored(shared.groupBy("doc_id").agg(F.sum("m").alias("score")), "scores")
    members = stored(shared.select("key", "doc_id").join(maybe_broadcast(scores), "doc_id"), "members")
    sets = stored(full_sets(docs, scores.select("doc_id"), repeated, config), "sets")
    centres = stored(members.groupBy("key").agg((-F.max(F.struct("score", -F.col("doc_id"))).getField("col2")).alias("c")), "centres")
    stars = stored(members.join(maybe_broadcast(centres), "key").where("doc_id != c").select(F.least("c", "doc_id").alias("a"), F.greatest("c", "doc_id").alias("b")).distinct(), "stars")
    links = stored(confirmed(stars, sets, config), "links")
    labels = stored(components(links), "components")
    stars_left = True
    while True:
        several = _several(members, labels)
        if not several.limit(1).count():
            break
        pairs = stored(_star(several) if stars_left else _block_pairs(several, sets, config), "stars")
        # all pairs of the round before have been asked, and those that are links lie in one component by now
        more = stored(confirmed(pairs.join(maybe_broadcast(stars), ["a", "b"], "left_anti"), sets, config), "links")
        stars = pairs
        linked = more.limit(1).count() > 0
        if linked:
            labels = stored(joined(labels, more), "components")
        if not stars_left:
            break  # all pairs that share a bucket have been looked at
        stars_left = linked
    named = classed.join(maybe_broadcast(labels.where("node != component")), F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """``docs`` with one document, the smallest ``doc_id``, of each near-duplicate group; columns unchanged."""
    found = stored(near_duplicates(docs.select("doc_id", "text"), config), "near")
    kept = without_ids(docs, stored(found.where("not kept").select("doc_id"), "dropped"))
    again = stored(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not again.limit(1).count():
        return kept
    repeated = kept.join(maybe_broadcast(again), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return without_ids(kept, again).unionByName(repeated)


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) AS component_id, l.m IS NULL OR s.doc_id <= l.m AS kept
FROM sets s LEFT JOIN least l ON s.doc_id = l.doc_id
"""
