"""Byte-level BPE against the tiktoken library, and against merging whole matches."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from arcwarden.llm import bpe

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, decoded int, n_tokens int, _in0 string"


def library(name="byte_bpe_50k.tiktoken"):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENC = library()
#: The tree down to single bytes, small trees with the smallest windows, and short chunks of texts.
CODECS = [bpe.codec(bpe.BpeConfig(chunk=30)), bpe.codec(bpe.BpeConfig(leaf=1, memory_chars=0)), bpe.codec(bpe.BpeConfig(leaf=3, window=1, memory=3, decode_leaf=1))]
PARTS = ["ab", "abc", " ", "  ", "\n ", "\t", "aeioustrnl", "the quick inering", "=-*/", "中文字é🙂", "0123", "'s't're", "\x1c\x1f  ​", "<|endoftext|>", "\0"]


def check(text):
    ids = ENC.encode_ordinary(text)
    for codec in CODECS:
        assert codec.encode(text) == ids
        assert codec.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=60).map("".join))
def test_any_text(text):
    check(text)


@pytest.mark.parametrize("alphabet", PARTS)
def test_long_matches(alphabet):
    rng = random.Random(alphabet)
    for size in (63, 64, 65, 128, 129, 1000, 3001):
        check("".join(rng.choice(alphabet) for _ in range(size)))
        check(alphabet[0] * size)


def test_very_long_matches():
    codec = bpe.codec(bpe.BpeConfig())
    for text in ("a" * 300_000, " " * 300_001, "ab" * 100_000 + "c", "x " * 200_000 + "\n" * 70_000):
        assert codec.encode(text) == ENC.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()


def test_joining_is_associative():
    codec, rng = CODECS[0], random.Random(4)
    for _ in range(300):
        piece = "".join(rng.choice("abeinrst") for _ in range(rng.randint(3, 90))).encode()
        i, j = sorted(rng.sample(range(1, len(piece)), 2))
        a, b, c = (codec.encode_piece(p) for p in (piece[:i], piece[i:j], piece[j:]))
        assert codec.joined(codec.joined(a, b), c) == codec.joined(a, codec.joined(b, c)) == codec.merged(piece) == codec._merged_short(piece) == codec._merged_long(piece)


def test_other_vocabulary():
    name = "byte_bpe_multi_50k.tiktoken"
    codec, enc = bpe.codec(bpe.BpeConfig(ranks=public_tokenizers.path(name))), library(name)
    for text in ("Größe und Übermaß " * 20, "数据处理" * 40, "été" + "s" * 200):
        assert codec.encode(text) == enc.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "a  b\n c"), (3, "a  b\n c"), (None, "nobody's"), (4, "word " * 400_000), (5, " "), (6, "<|endoftext|> 🙂")]
    frame = spark.createDataFrame([(*r, "x", 7, 8, "y") for r in rows], SCHEMA)
    found = bpe.decode_ids(bpe.encode_texts(frame))
    assert found.columns == ["doc_id", "text", "n_tokens", "_in0", "ids", "decoded"]
    got = found.collect()
    assert len(got) == len(rows) and all(r["ids"] == ENC.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode() and r["_in0"] == "y" for r in got)
    assert bpe.encode_texts(frame.where("false")).count() == 0
    assert bytes(bpe.decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["decoded"]) == b""


def test_query(spark):
    texts = {r["doc_id"]: (r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in bpe.op11_bpe(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        ids = ENC.encode_ordinary(text)
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
