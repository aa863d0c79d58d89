"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each a group of whole WARC records of about ``frame_bytes``, then a
skippable frame with the record index (record id, frame, offset in the frame, length), then the footer: the seek table of the
Zstandard seekable format (a skippable frame of each frame's compressed and plain size). One record is read by
decompressing one frame. Any Zstandard reader can read a bundle as one stream of WARC records.

Of pages with equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id is a response record; the others are revisit
records that carry the payload's digest and length and refer to it, without the payload.

Defined results: a null html is an empty payload; a null url leaves the header out; a page without page_id is a revisit if its
payload has a response, else a response; rows that repeat the smallest page_id of a payload are all responses; an empty table
makes no bundle; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, stored

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 24
MIN_BYTES = 0
INDEX_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with its HTTP response head; a revisit has the head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    block = http if refers_to is not None else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place, and where the next one is."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, n = end + 4, int(head["Content-Length"])
    if raw[start + n : start + n + 4] != b"\r\n\r\n":
        raise ValueError("WARC record without its end")
    return head, raw[start : start + n], start + n + 4


def write_bundle(records: list[tuple[int | None, bytes]], frame_bytes: int = FRAME_BYTES, level: int = 3) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=level)
    out, seek, index, frame, held = [], [], [], [], 0

    def close() -> None:
        nonlocal frame, held
        plain = b"".join(frame)
        out.append(squeeze.compress(plain))
        seek.append(struct.pack("<II", len(out[-1]), len(plain)))
        frame, held = [], 0

    for page_id, raw in records:
        index.append(struct.pack("<?qIQQ", page_id is not None, page_id or 0, len(out), held, len(raw)))
        frame.append(raw)
        held += len(raw)
        if held >= frame_bytes:
            close()
    if frame:
        close()
    own = squeeze.compress(b"".join(index))
    table = b"".join(seek) + struct.pack("<IBI", len(seek), 0, SEEKABLE)
    return b"".join([*out, struct.pack("<II", INDEX_MAGIC, len(own)), own, struct.pack("<II", SEEK_MAGIC, len(table)), table])


class Bundle:
    """Random access to the records of a bundle."""

    def __init__(self, raw: bytes):
        n, _, magic = struct.unpack("<IBI", raw[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        sizes = list(struct.iter_unpack("<II", raw[-9 - 8 * n : -9]))
        self.raw, self.frames, at = raw, [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed
        magic, size = struct.unpack_from("<II", raw, at)
        if magic != INDEX_MAGIC:
            raise ValueError("no record index")
        own = zstandard.ZstdDecompressor().decompress(raw[at + 8 : at + 8 + size]) if size else b""
        self._places: dict[int | None, tuple[int, int]] | None = None
        self.index = [(i if there else None, f, a, k) for there, i, f, a, k in struct.iter_unpack("<?qIQQ", own)]

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.raw[at : at + packed], max_output_size=plain)

    def record(self, page_id: int | None) -> tuple[dict[str, str], bytes]:
        """Headers and block of the first record of an id; decompresses its frame only. A KeyError if there is none."""
        if self._places is None:
            self._places = {i: (f, a) for i, f, a, _ in reversed(self.index)}
        f, a = self._places[page_id]
        return parse(self.frame(f), a)[:2]

    def __iter__(self) -> Iterator[tuple[int | None, dict[str, str], bytes]]:
        now, plain = -1, b""
        for page_id, f, a, n in self.index:
            if f != now:
                now, plain = f, self.frame(f)
            head, block, end = parse(plain, a)
            if end - a != n:
                raise ValueError("record index and record differ")
            yield page_id, head, block


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload an earlier page has. Only ids and digests are shuffled."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    ids = pages.filter(F.length(html) >= min_bytes).select("page_id", F.sha1(html).alias("digest"))
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return join_unique(ids, stored(first, "payloads"), "digest", "n", pages.count()).filter("page_id is null or page_id > refers_to").filter("refers_to is not null").select("page_id", "digest", "refers_to").distinct()


def write_bundles(pages: DataFrame, min_bytes: int = MIN_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(n_records, bundle) of all pages, in the shared folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).alias("p")
    again = revisits(rows, min_bytes).alias("r")
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest"))
    joined = keyed.join(again, same, "left").select("p.page_id", "p.url", "p.html", "r.refers_to")

    def run(batches):
        records, held = [], 0

        def out():
            return pa.RecordBatch.from_pydict({"n_records": pa.array([len(records)], pa.int64()), "bundle": pa.array([write_bundle(records, frame_bytes)], pa.binary())})

        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records.append((page_id, record(page_id, url, html.encode(), refers)))
                held += len(records[-1][1])
                if held >= bundle_bytes:
                    yield out()
                    records, held = [], 0
        if records:
            yield out()

    return stored(joined.mapInArrow(run, "n_records long, bundle binary"), "warc")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record. Payloads of responses are digested anew."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                out = []
                for page_id, head, block in Bundle(raw):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
                        raise ValueError(f"damaged record {page_id}")
                    refers = head.get("WARC-Refers-To")
                    out.append((page_id, size, digest, head["WARC-Type"], None if refers is None else int(refers[10:-1])))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.select("bundle").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), h AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p
), b AS (
  SELECT page_id, payload_bytes, hex,
    array_to_string(list_transform(string_split(hex, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * CAST(strpos('0123456789abcdef', c) AS INTEGER) - 3, 4)), '') AS bits,
    min(page_id) OVER (PARTITION BY hex) AS first_id
  FROM h
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER)
      + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM b
"""
