"""WARC archives with one Zstandard frame a record, and their reader.

An archive starts with a skippable frame that holds the compression dictionary, and every record is one frame of its own, so
that a reader can start at any record. Spark's text writer makes the files: a row is a frame's bytes, and the line separator
is an empty skippable frame, which every Zstandard reader passes over. So archives are written to, and read from (as
``binaryFile``), whatever store Spark reaches, by all executors at once.

Records with equal payloads share one response record, that of the smallest ``page_id``; the others are revisit records,
which carry the HTTP header with the payload's length, its digest, and the response's record id, but no payload.

The reader loads the dictionary, decodes frame by frame, and checks every record: version line, needed headers, block length
against Content-Length, the two line ends after the block, and the payload's length and digest.

An archive is made of one partition of the input, and read as one row, so a partition must stay below 2 GB compressed; scans
of ``spark.sql.files.maxPartitionBytes`` (128 MB by default) do. Records are handed on in batches of some 16 MB.

Edge cases: a null html is an empty payload; a null url leaves out the target; a row without a ``page_id`` is always a
response; repeated rows make repeated records. An empty table makes archives without records. A record is decoded whole.
Columns other than ``page_id``, ``url`` and ``html`` aren't written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwarden.llm.common import fresh_path, maybe_broadcast, small_batches, stored, table

DICT_MAGIC = 0x184D2A5D
#: An empty skippable frame, all ASCII.
FRAME_END = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGEST = re.compile(r"[A-Z2-7]{32}")
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


@dataclass(frozen=True)
class WarcConfig:
    #: Payloads of fewer bytes are all responses.
    revisit_min_bytes: int = 0
    level: int = 3
    dict_bytes: int = 32 << 10
    #: Pages that the dictionary is trained on, by a hash, and characters of each.
    dict_pages: int = 400
    dict_chars: int = 16_384
    date: str = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame, config: WarcConfig) -> bytes:
    """A Zstandard dictionary from the starts of a bounded sample of pages; empty where there is too little to learn from.

    The sample is chosen by hashes alone, so that tasks send no pages but the chosen ones.
    """
    import zstandard

    hashed = pages.where(F.length("html") > 0).select(F.xxhash64("page_id", "url").alias("h"), "html")
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(config.dict_pages).collect()]
    drawn = hashed.where(F.col("h").isin(least)).groupBy("h").agg(F.min(F.substring("html", 1, config.dict_chars)).alias("html")).orderBy("h").collect()
    try:
        return zstandard.train_dictionary(config.dict_bytes, [r["html"].encode() for r in drawn]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    if not (record_id.startswith("<urn:page:") and record_id.endswith(">")):
        raise WarcError(f"record id {record_id!r}")
    number = record_id[10:-1]
    if number and not number.removeprefix("-").isdigit():
        raise WarcError(f"record id {record_id!r}")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, config: WarcConfig) -> bytes:
    """A response record, or a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {config.date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    head += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip() or name != name.strip():
            raise WarcError(f"header line {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _split(data: bytes, what: str) -> tuple[list[bytes], bytes]:
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError(f"{what} without an end of its headers")
    return head.split(b"\r\n"), rest


def parse_record(data: bytes) -> dict:
    """Page id, url, type, payload (None for revisits), payload length and digest, and refers_to of a record's bytes."""
    lines, rest = _split(data, "record")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"version line {lines[0][:40]!r}")
    head = _headers(lines[1:])
    if missing := [h for h in NEEDED if h not in head]:
        raise WarcError(f"no {', '.join(missing)}")
    if not head["content-length"].isdigit() or (length := int(head["content-length"])) + 4 != len(rest) or rest[length:] != b"\r\n\r\n":
        raise WarcError("block and Content-Length differ")
    kind = head["warc-type"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"record type {kind!r}")
    status, body = _split(rest[:length], "HTTP message")
    if not status[0].startswith(b"HTTP/"):
        raise WarcError(f"status line {status[0][:40]!r}")
    http = _headers(status[1:])
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if not http.get("content-length", "").isdigit():
        raise WarcError(f"HTTP Content-Length {http.get('content-length')!r}")
    size = int(http["content-length"])
    if not DIGEST.fullmatch(digest):
        raise WarcError(f"payload digest {digest[:80]!r}")
    if kind == "response" and (len(body) != size or payload_digest(body) != digest):
        raise WarcError("payload differs from its length or digest")
    if kind == "revisit" and (body or "warc-refers-to" not in head):
        raise WarcError("revisit with a payload or without what it refers to")
    return {"page_id": _page(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": kind, "payload": body if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "refers_to": _page(head["warc-refers-to"]) if kind == "revisit" else None}


def read_frames(archive: bytes) -> Iterator[bytes]:
    """The records' bytes: one for each Zstandard frame, decoded with the dictionary of the leading skippable frame."""
    import zstandard

    at, context, view = 0, zstandard.ZstdDecompressor(), memoryview(archive)
    while at < len(archive):
        if at + 8 > len(archive):
            raise WarcError("the archive ends inside a frame")
        magic, size = struct.unpack_from("<II", archive, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 + size > len(archive):
                raise WarcError("the archive ends inside a skippable frame")
            if magic == DICT_MAGIC and at == 0 and size:
                content = bytes(view[8 : 8 + size])
                if content[:4] == b"\x28\xb5\x2f\xfd":
                    content = zstandard.ZstdDecompressor().decompress(content)
                context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
            continue
        frame, parts, step = context.decompressobj(), [], 1 << 14
        while not frame.eof:
            if at >= len(archive):
                raise WarcError("the archive ends inside a frame")
            chunk = view[at : at + step]
            parts.append(frame.decompress(chunk))
            at += len(chunk) - len(frame.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, path: str, config: WarcConfig = WarcConfig()) -> None:
    """One archive for each partition of ``pages(page_id, url, html)``, under ``path``."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("key", F.sha1("html"))
    worth = keyed.where((F.octet_length("html") >= config.revisit_min_bytes) & F.col("page_id").isNotNull())
    shared = stored(worth.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "payloads")
    marked = keyed.join(maybe_broadcast(shared), "key", "left").select("page_id", "url", "html", F.when((F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))
    dictionary = train_dictionary(rows, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, begun = zstandard.ZstdCompressor(level=config.level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None), False
        for batch in batches:
            frames = [] if begun else [dictionary_frame(dictionary)]
            begun = True
            for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), strict=True):
                frames.append(packer.compress(record(page_id, url, html.as_py(), refers_to, config)))
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    marked.mapInArrow(run, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", FRAME_END).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``; fails on a record that isn't whole. ``payloads``: return html too."""
    small_batches(spark, 4)
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for data in read_frames(archive.as_py()):
                    rows.append(parse_record(data) | ({} if payloads else {"payload": None}))
                    size += len(data) * payloads + 200
                    if size > 1 << 24:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def broken_revisits(records: DataFrame) -> DataFrame:
    """Revisits whose response is missing or has another digest or length: what no record shows by itself."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).dropDuplicates()
    same = (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    revisits = records.where("record_type = 'revisit'")
    good = revisits.join(responses, "refers_to").where(same).select("page_id", "refers_to").distinct()
    return revisits.join(good, ["page_id", "refers_to"], "left_anti").select(*records.columns)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base32: the digest's 160 bits are cut into 32 groups of five.
OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT h, min(page_id) AS first, count(page_id) AS n FROM p GROUP BY h
), d AS (
  SELECT h, list_aggregate(list_transform(range(0, 160, 5), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h || '0', (i // 4) + 1, 2))::INT) >> (3 - i % 4)) & 31)::INT, 1)), 'string_agg', '') AS digest
  FROM f
)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN p.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN f ON p.h = f.h JOIN d ON p.h = d.h
"""
