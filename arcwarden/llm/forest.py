"""Approximate nearest neighbours with a hash-prefix forest.

Every vector gets one long hash string for each tree: the signs of random projections, as an unsigned integer whose leading
bits are the string's start. A tree is the sorted array of its strings, in which all strings of a given prefix lie side by
side. A query descends in every tree to its longest match, then all trees ascend together, one bit at a time, until the
vectors under their prefixes are at least ``share`` of the shard (or ``least`` vectors, if that is more). The candidates are
scored exactly, in double precision, on the original vectors.

Inner products are searched as angles after one more coordinate brings all vectors to one length. Vectors are dealt to
shards of bounded size, each with a forest of its own; queries are dealt to blocks, and each block meets each shard in a
group. A shard's best are merged by grouped ranking. All vectors are indexed; no copy or tie is left out, as equal vectors
have equal strings.

``share`` sets recall: vectors without structure (independent normal coordinates) need about a third of the rows for a
recall of 0.9 at 20 neighbours, vectors with clusters far less.

Edge cases: vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do rows without an id.
Repeated rows of an id count once. Vectors of different lengths never meet. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwarden.llm.common import small_batches, stored, table


@dataclass(frozen=True)
class ForestConfig:
    k: int = 20
    trees: int = 128
    bits: int = 32
    share: float = 0.36
    least: int = 400
    shard_rows: int = 8192
    block_queries: int = 4096
    seed: int = 5


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` of the rows that take part, with double components."""
    v = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return rows.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(fine)


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("vec_id").to_numpy()
    flat = t.column("v").combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return ids, flat.to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def hash_strings(x: np.ndarray, config: ForestConfig) -> np.ndarray:
    """``trees x rows`` strings of ``bits`` bits as unsigned integers."""
    planes = np.random.default_rng(config.seed).standard_normal((config.trees, config.bits, x.shape[1])).astype(np.float32)
    weights = (np.uint64(1) << np.arange(config.bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
    low = x.astype(np.float32)
    return np.stack([((low @ p.T) > 0) @ weights for p in planes])


def search_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, longest: float, config: ForestConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of one shard for each query: query ids, ids, scores."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    scaled = x / longest
    lifted = np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1, keepdims=True)))])
    strings = hash_strings(lifted, config)
    trees = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
    arrays = np.take_along_axis(strings, trees, axis=1)
    asked = hash_strings(np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))]), config)
    wanted = min(len(ids), max(config.least, int(np.ceil(config.share * len(ids)))))
    open_, found = np.arange(len(q)), [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    for depth in range(config.bits, -1, -1):  # all trees ascend together
        if not len(open_):
            break
        drop = np.uint64(config.bits - depth)
        prefix = asked[:, open_] >> drop
        low = np.stack([np.searchsorted(a, p << drop) for a, p in zip(arrays, prefix, strict=True)])
        high = np.stack([np.searchsorted(a, (p + np.uint64(1)) << drop) for a, p in zip(arrays, prefix, strict=True)])
        enough = np.flatnonzero((high - low).sum(axis=0) >= wanted)
        settled = []
        for k in enough:
            mask = np.zeros(len(ids), np.bool_)
            mask[np.concatenate([t[s:e] for t, s, e in zip(trees, low[:, k], high[:, k], strict=True)])] = True
            near = np.flatnonzero(mask)
            if len(near) < wanted:
                continue
            settled.append(k)
            _best(ids, x, near, query_ids[open_[k]], q[open_[k]], config.k, found)
        open_ = np.delete(open_, settled)
    return tuple(np.concatenate(f) for f in found)


def _best(ids: np.ndarray, x: np.ndarray, near: np.ndarray, query_id: int, query: np.ndarray, k: int, found: list) -> None:
    """Add the ``k`` best candidates of one query, ties to the smaller id, each id once, never the query's own."""
    near = near[ids[near] != query_id]
    rough = x[near] @ query
    if len(near) > 4 * k:
        heads = np.flatnonzero(np.diff(ids[near], prepend=ids[near[0]] - 1))  # ids are sorted: each id's best row stands for it
        most = np.maximum.reduceat(rough, heads) if len(heads) < len(rough) else rough
        floor = np.partition(most, max(0, len(most) - 2 * k))[max(0, len(most) - 2 * k)]
        near = near[rough >= floor - 1e-9 * max(1.0, abs(floor))]
    score = np.multiply(x[near], query).sum(axis=1)
    first = np.lexsort((ids[near], -score))
    near, score = near[first], score[first]
    _, once = np.unique(ids[near], return_index=True)
    once = np.sort(once)[:k]
    found[0].append(np.full(len(once), query_id))
    found[1].append(ids[near[once]])
    found[2].append(score[once])


def nearest(rows: DataFrame, queries: DataFrame, config: ForestConfig = ForestConfig()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each query; both have ``vec_id`` and ``embedding``."""
    spark = rows.sparkSession
    small_batches(spark, 4096)
    index = usable(rows).dropDuplicates()
    asked = usable(queries).dropDuplicates(["vec_id"])
    n, length = index.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))).first()
    n_queries = asked.count()
    shards, blocks = max(1, -(-n // config.shard_rows)), max(1, -(-n_queries // config.block_queries))
    longest = float(length or 1.0)
    deal = lambda parts, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = index.select("vec_id", "v", F.size("v").alias("dim"), deal(shards, 1).alias("shard"), every(blocks).alias("block"))
    right = asked.select("vec_id", "v", F.size("v").alias("dim"), every(shards).alias("shard"), deal(blocks, 2).alias("block"))

    def search(own: pa.Table, other: pa.Table) -> pa.Table:
        if own.num_rows and other.num_rows:
            found = search_shard(*_matrix(own), *_matrix(other), longest, config)
        else:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    keys = ["dim", "shard", "block"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return stored(local, "local").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "score")


def op9_forest(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
