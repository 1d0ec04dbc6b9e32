"""Seekable WARC bundles of pages.

Records are grouped into independent Zstandard frames, frames into bundles. A bundle
ends with a seek table in a skippable frame (the public seekable format: compressed and
decompressed size per frame, then a footer), and its index maps each record id to a
frame and the record's offset inside the decompressed frame. A bundle is one row of a
Parquet table in the shared folder, so that it can be kept in any store that Spark
reaches; ``bundle_bytes`` holds a whole ``.warc.zst`` file.

Records with equal payloads of at least ``min_payload`` bytes: the one with the smallest
page id is a ``response``, the others are ``revisit`` records that name it and hold no
payload.

Defined cases: null html is an empty payload; a null url gives a record without target
URI; rows without a page id are never the first of their payload while a row with an id
exists, and are all responses otherwise; rows that repeat the page id of the response are
responses too; extra columns are ignored; an empty table gives no bundles.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1      # fixed values of the seekable format
INDEX = T.ArrayType(T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("frame", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))
BUNDLES = T.StructType([
    T.StructField("bundle_id", T.StringType()), T.StructField("bundle_bytes", T.BinaryType()),
    T.StructField("records", T.LongType()), T.StructField("index", INDEX)])
RECORDS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType())])


def mark_revisits(pages: DataFrame, min_payload: int = 100) -> DataFrame:
    """page_id, url, html, payload_digest, record_type, refers_to of every row.

    The first page of each payload comes from a partial aggregate over digests; only
    payloads that occur again take part in the join, which Spark may split for a hot payload.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("payload_digest", F.sha2(F.encode("html", "UTF-8"), 256))
    first = (p.filter(F.octet_length("html") >= min_payload).groupBy("payload_digest")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select("payload_digest", "first_id"))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (p.join(first, "payload_digest", "left")
            .select("page_id", "url", "html", "payload_digest",
                    F.when(again, "revisit").otherwise("response").alias("record_type"),
                    F.when(again, F.col("first_id")).alias("refers_to")))


def record_bytes(record_id: str, page_id, url, kind: str, refers_to, digest: str, payload: bytes, size: int,
                 date: str) -> bytes:
    """One WARC/1.1 record with its two closing line ends."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
            "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {size}"]
    if url is not None:
        from urllib.parse import quote

        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))     # not ASCII: %XX
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"X-Refers-To-Page-ID: {refers_to}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Collects records into frames and closes as one seekable file."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame_bytes, self.frames, self.table, self.index = frame_bytes, [], [], []
        self.held, self.size, self.total = [], 0, 0

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.size, len(record)))
        self.held.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            self.frames.append(packed := self.packer.compress(raw))
            self.table.append((len(packed), len(raw)))
            self.total += len(packed)
            self.held, self.size = [], 0

    def close(self) -> bytes:
        self.end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer


def write_bundles(marked: DataFrame, date: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 22,
                  level: int = 3) -> DataFrame:
    """Rows of bundles from rows of ``mark_revisits``; a task closes a bundle at about ``bundle_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import uuid

        def emit(b: Bundle) -> pa.RecordBatch:
            raw = b.close()
            index = [dict(zip(("record_id", "frame", "offset", "length"), x, strict=True)) for x in b.index]
            name = hashlib.sha256("".join(x[0] for x in b.index).encode()).hexdigest()[:32]
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([raw], pa.binary()), pa.array([len(index)], pa.int64()),
                 pa.array([index], pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()),
                                                       ("offset", pa.int64()), ("length", pa.int64())])))],
                ["bundle_id", "bundle_bytes", "records", "index"])

        bundle, seen = Bundle(frame_bytes, level), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for r in batch.slice(at, 200).to_pylist():
                    payload = r["html"].encode("utf-8")
                    name = f"{r['page_id']}\n{r['url']}\n{r['payload_digest']}"
                    seen[name] = n = seen.get(name, -1) + 1       # rows that are repeated whole
                    rid = "urn:uuid:" + str(uuid.UUID(bytes=hashlib.sha256(f"{name}\n{n}".encode()).digest()[:16]))
                    body = b"" if r["record_type"] == "revisit" else payload
                    bundle.add(rid, record_bytes(rid, r["page_id"], r["url"], r["record_type"], r["refers_to"],
                                                 r["payload_digest"], body, len(payload), date))
                    if bundle.total >= bundle_bytes:
                        yield emit(bundle)
                        bundle, seen = Bundle(frame_bytes, level), {}
        if bundle.index:
            yield emit(bundle)

    return marked.mapInArrow(run, BUNDLES)


def seek_table(raw: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the footer of a bundle."""
    frames, flags, magic = struct.unpack("<IBI", raw[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    step = 12 if flags & 0x80 else 8
    at, out = len(raw) - 9 - frames * step, []
    offset = 0
    for i in range(frames):
        packed, size = struct.unpack_from("<II", raw, at + i * step)
        out.append((offset, packed, size))
        offset += packed
    return out


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at ``at``, and where the next one begins."""
    import hashlib

    end = raw.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in raw[at:end].decode("utf-8").split("\r\n")[1:])
    start, size = end + 4, int(head["Content-Length"])
    block = raw[start:start + size]
    payload = block[block.index(b"\r\n\r\n") + 4:]
    kind = head["WARC-Type"]
    num = lambda k: int(head[k]) if k in head else None
    out = {"record_id": head["WARC-Record-ID"][1:-1], "page_id": num("X-Page-ID"),
           "url": head.get("WARC-Target-URI"),
           "record_type": kind, "refers_to": num("X-Refers-To-Page-ID"),
           "payload_bytes": len(payload) if kind == "response" else num("X-Payload-Length"),
           "payload_digest": hashlib.sha256(payload).hexdigest() if kind == "response"
           else head["WARC-Payload-Digest"].split(":", 1)[1],
           "payload": payload if kind == "response" else None}
    return out, start + size + 4


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of every bundle, frame by frame. Size and digest of a response are taken from
    its payload as read; those of a revisit from its headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        kinds = [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                 ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                 ("payload_digest", pa.string()), ("payload", pa.binary())]
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for cell in batch.column("bundle_bytes"):
                whole = cell.as_py()
                for offset, packed, size in seek_table(whole):
                    raw, at, rows = unpack.decompress(whole[offset:offset + packed], max_output_size=size), 0, []
                    while at < len(raw):
                        row, at = parse_record(raw, at)
                        rows.append(row)
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return bundles.select("bundle_bytes").mapInArrow(run, RECORDS)


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle_id, frame, offset (in the decompressed frame), length of every record."""
    return bundles.select("bundle_id", F.explode("index").alias("x")).select("bundle_id", "x.*")


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> dict:
    """One record by its index entry; only its frame is decompressed."""
    import zstandard

    at, packed, size = seek_table(bundle)[frame]
    raw = zstandard.ZstdDecompressor().decompress(bundle[at:at + packed], max_output_size=size)
    return parse_record(raw[offset:offset + length])[0]
