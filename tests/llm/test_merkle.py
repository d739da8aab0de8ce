"""The Merkle manifest against a plain version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from arcwarden.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, hash string, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(nodes, fan):
    """The root of a sequence of hashes, and the path of each as (left, right) pairs."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // fan * fan : place // fan * fan + fan]
            paths[k].append(("".join(run[: place % fan]), "".join(run[place % fan + 1 :])))
        nodes = [sha("".join(nodes[k : k + fan])) for k in range(0, len(nodes), fan)]
        at = [place // fan for place in at]
    return nodes[0], paths


def plain(rows, fan=16):
    sources = {}
    for row in rows:
        sources.setdefault((row["source"] is not None, (row["source"] or "").encode()), []).append(row)
    grown, out = [], []
    for key in sorted(sources):
        own = sorted(sources[key], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        grown.append((own, *grow([leaf(r, r["text"]) for r in own], fan)))
    root, tops = grow([g[1] for g in grown], fan)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for (own, subroot, paths), top in zip(grown, tops, strict=True):
        for row, path in zip(own, paths, strict=True):
            touched = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"] is not None
            first = node = leaf(row, row["text"])
            if touched:
                node = leaf(row, row["text"].translate(low))
            for left, right in path + top:
                node = sha(left + node + right)
            out.append((row["doc_id"], first, subroot, root, sha("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=str)


def rows_of(table):
    return sorted((tuple(r) for r in table.collect()), key=str)


def read(spark, tmp_path, rows):
    frame = spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return [r.asDict() for r in frame.collect()]


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 2, 300], [1] * 20, [257, 1, 16, 5]])
def test_manifest(spark, tmp_path, sizes):
    rows, k = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((k, f"Text {k} äÖ", "en" if k % 3 else None, f"s{s}é" if s else None, k % 7))
            k += 1
    given = read(spark, tmp_path, rows)
    assert rows_of(merkle.op13_merkle(spark, str(tmp_path))) == plain(given)


def test_odd_rows(spark, tmp_path):
    rows = [(5, None, None, None, None), (5, "", "", "", 0), (5, "AB", "x", "", -1), (5, "AB", "x", "", -1), (None, "Q", "x", "", 3), (None, None, None, None, None), (-7, "Long " * 300_000, "x", "y\U0001f600", 1), (8, "a:b", "1:-", "-", 9)]
    rows += [(10, "same", "en", "z", 4)] * 40
    given = read(spark, tmp_path, rows)
    assert rows_of(merkle.op13_merkle(spark, str(tmp_path))) == plain(given)


def test_empty(spark, tmp_path):
    read(spark, tmp_path, [])
    assert merkle.op13_merkle(spark, str(tmp_path)).count() == 0


def test_other_fan(spark):
    rows = [(k, f"t{k}", "en", f"s{k % 3}", 1, "own", "own", "own") for k in range(50)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(frame, merkle.MerkleConfig(fan=3)).withColumn("again", merkle.folded(F.col("leaf"), F.col("path")))
    want = {r[0]: r[3] for r in plain([r.asDict() for r in frame.collect()], 3)}
    got = found.collect()
    assert len(got) == 50 and all(r["root"] == r["again"] == want[r["doc_id"]] for r in got)
