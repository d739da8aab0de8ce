"""Byte-level BPE by monoid tree reduction.

A text is cut into matches of the vocabulary's pattern, each encoded separately: neighbours are merged, the pair of lowest rank
first, leftmost among equals. A match of more than ``leaf`` bytes is encoded by halves, recursively, and the two encodings are
joined: the tokens beside the border are taken out and their bytes encoded anew, in a window that grows until its outermost
tokens come out as they were. Then nothing outside can change. For a sequence of tokens, each of them the encoding of its own
bytes, is the encoding of all bytes if every two neighbours are the encoding of theirs: the first merge across a border between
tokens would be the lowest in these two alone as well, so it would show there. All pairs beside the window's ends were pairs of
an encoding before, and all inside come from one. So joining is associative, and the result that of merging the match as a whole.


Halves are cut where the left one is ``leaf`` times a power of two long, so that runs of one character come out in step and
windows stay small.

Decoding concatenates the tokens' bytes up a tree, halves first.

No match of the pattern goes on from other characters to white space, nor does one before such a place depend on what follows. So
a text is taken apart at its spaces and line ends first, and a worker remembers the ids of short words, up to ``memory`` of
them. A task holds a text with its ids; a match has no bound on its length. Ranks are read on each worker from the vocabulary file.

Edge cases: a null text is an empty one, without ids; invalid UTF-8 counts as U+FFFD. Names of special tokens are ordinary text.
Ids that the vocabulary lacks, and nulls among ids, are an error when decoding; a null array decodes to no bytes. Repeated rows, a null ``doc_id`` and extra columns pass through; ``ids`` and
``decoded`` of the input are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwarden.llm.common import positional, schema_with, small_batches, table


@dataclass(frozen=True)
class BpeConfig:
    #: File of ranks (a token in base64, a space, its rank): a path, or a name that the installed ``public_tokenizers`` knows.
    ranks: str = "byte_bpe_50k.tiktoken"
    #: Bytes of a match that are merged directly, and tokens on each side of the first window of a join.
    leaf: int = 64
    window: int = 2
    #: Words whose encodings a worker remembers, and characters of the longest of them.
    memory: int = 800_000
    memory_chars: int = 32
    #: Characters of a very long text that are taken apart at once.
    chunk: int = 1 << 20
    #: Ids that are concatenated at once when decoding.
    decode_leaf: int = 4096


class Codec:
    """Encoder and decoder of one vocabulary, on a worker."""

    def __init__(self, config: BpeConfig):
        import public_tokenizers
        import regex

        self.config = config
        path = Path(config.ranks) if "/" in config.ranks else Path(public_tokenizers.path(config.ranks))
        self.ranks: dict[bytes, int] = {}
        for line in path.read_bytes().splitlines():
            if line:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.none = max(self.ranks.values()) + 1
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pairs = [self.ranks.get(bytes((k >> 8, k & 255)), self.none) for k in range(1 << 16)]
        self.matches = regex.compile(public_tokenizers.PATTERN).finditer
        self.blank = regex.compile(r"\s").search
        self.border = regex.compile(r"(?<=\S) ").search
        #: Ids of words after a space, and of words by themselves; of marks that follow a word.
        self.known: tuple[dict[str, tuple[int, ...]], ...] = ({}, {})
        self.marks = {c: (self.ranks[c.encode()],) for c in ".,;:!?" if c.encode() in self.ranks}
        self.line_end = self.ranks.get(b"\n")

    def _merged_short(self, piece: bytes) -> list[int]:
        """Ids of a few bytes by merging neighbours, lowest rank first."""
        rank, none, two = self.ranks.get, self.none, self.pairs
        cuts = list(range(len(piece) + 1))
        pairs = [two[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        while pairs and (least := min(pairs)) != none:
            k = pairs.index(least)
            del pairs[k], cuts[k + 1]
            if k < len(pairs):
                pairs[k] = rank(piece[cuts[k] : cuts[k + 2]], none)
            if k:
                pairs[k - 1] = rank(piece[cuts[k - 1] : cuts[k + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _merged_long(self, piece: bytes) -> list[int]:
        """Ids of a long window by merging neighbours, with a heap of pairs."""
        ranks, size = self.ranks, len(piece)
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))  # of the part that starts at a place
        heap = [(rank, k, k + 2) for k in range(size - 1) if (rank := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * size
        while heap:
            _, start, stop = heapq.heappop(heap)
            middle = end[start]
            if not alive[start] or middle >= size or end[middle] != stop or not alive[middle]:
                continue  # one of the two parts has grown since
            alive[middle] = 0
            end[start] = stop
            if stop < size:
                before[stop] = start
                if (rank := ranks.get(piece[start : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, start, end[stop]))
            if (left := before[start]) >= 0 and (rank := ranks.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (rank, left, stop))
        out, at = [], 0
        while at < size:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encodings' bytes together."""
        a = b = self.config.window
        tokens = self.tokens
        while True:
            head, tail = left[-a:], right[:b]
            window = b"".join([tokens[t] for t in head + tail])
            middle = self._merged_short(window) if len(window) <= self.config.leaf else self._merged_long(window)
            steady_left = a >= len(left) or middle[0] == head[0]
            steady_right = b >= len(right) or middle[-1] == tail[-1]
            if steady_left and steady_right:
                return left[: len(left) - len(head)] + middle + right[len(tail) :]
            a, b = a if steady_left else 4 * a, b if steady_right else 4 * b

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece by the tree of its halves."""
        if len(piece) <= self.config.leaf:
            return self._merged_short(piece)
        half = self.config.leaf
        while 2 * half < len(piece):
            half *= 2
        return self.joined(self.merged(piece[:half]), self.merged(piece[half:]))

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of a match; one that is a token is that token, whether or not merging would make it."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.merged(piece)

    def _stretch(self, stretch: str) -> list[int]:
        """Ids of any text, match by match."""
        return [token for match in self.matches(stretch) for token in self.encode_piece(match[0].encode())]

    def _word(self, word: str, alone: bool) -> tuple[int, ...]:
        """Ids of a word without white space, by itself or after a space."""
        known = self.known[alone]
        ids = known.get(word)
        if ids is None:
            if word[-1] in self.marks and len(word) > 1 and (c := word[-2]).isascii() and c.isalnum():
                ids = self._word(word[:-1], alone) + self.marks[word[-1]]  # the mark is a match by itself
            elif word.isascii() and word.isalpha():
                ids = tuple(self.encode_piece((word if alone else " " + word).encode()))  # and so are letters, with a space before
            else:
                ids = tuple(self._stretch(word if alone else " " + word))
            if len(word) <= self.config.memory_chars:
                if len(known) >= self.config.memory:
                    known.clear()
                known[word] = ids
        return ids

    def _spaced(self, text: str, out: list[int]) -> None:
        """Add the ids of a text to ``out``: stretch by stretch, each from a space after other characters to the next."""
        known, words = self.known[False], iter(text.split(" "))
        rest: str | None = next(words)  # what isn't encoded yet; None where a stretch ends
        if rest and not self.blank(rest):
            out.extend(self._word(rest, True))
            rest = None
        for word in words:
            if rest is None and (ids := known.get(word)) is not None:
                out.extend(ids)
                continue
            if not word or self.blank(word[-1]):
                rest = f"{rest or ''} {word}"
                continue
            lines = word.split("\n")
            if rest is None and all(lines) and self.line_end is not None and not any(map(self.blank, lines)):
                # a line end between other characters is a match by itself
                out.extend(self._word(lines[0], False))
                for line in lines[1:]:
                    out.append(self.line_end)
                    out.extend(self._word(line, True))
            else:
                out.extend(self._stretch(f"{rest or ''} {word}"))
            rest = None
        if rest:
            out.extend(self._stretch(rest))

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        out: list[int] = []
        at = 0
        while at < len(text):
            border = self.border(text, at + self.config.chunk)
            end = border.start() if border else len(text)
            self._spaced(text[at:end], out)
            at = end
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, concatenated up a tree of halves."""
        if len(ids) <= self.config.decode_leaf:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.cache
def codec(config: BpeConfig) -> Codec:
    return Codec(config)


def _with_column(docs: DataFrame, source: str, name: str, kind: str, arrow: pa.DataType, value) -> DataFrame:
    """``docs`` with the column ``name``, made of the column ``source`` by a function of its Arrow values, batch by batch."""
    docs = docs.drop(name)
    plain, names = positional(docs)
    at = docs.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([value(v) for v in batch.column(at)], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    small_batches(docs.sparkSession)
    assert names[source] == plain.columns[at]
    return plain.mapInArrow(run, schema_with(plain, f"{name} {kind}")).toDF(*docs.columns, name)


def encode_texts(docs: DataFrame, config: BpeConfig = BpeConfig(), text: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>``, the encoding of its whole texts."""

    def ids(value: pa.Scalar) -> list[int]:
        data = value.as_buffer().to_pybytes() if value.is_valid else b""
        return codec(config).encode(data.decode(errors="replace"))

    return _with_column(docs, text, "ids", "array<int>", pa.list_(pa.int32()), ids)


def decode_ids(docs: DataFrame, config: BpeConfig = BpeConfig(), ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded binary``, the bytes of its ids."""

    def decoded(value: pa.Scalar) -> bytes:
        return codec(config).decode(value.values.to_numpy(zero_copy_only=False).tolist() if value.is_valid else [])

    return _with_column(docs, ids, "decoded", "binary", pa.binary(), decoded)


def op11_bpe(spark, sf_dir: str) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    both = decode_ids(encoded)
    numbers = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
