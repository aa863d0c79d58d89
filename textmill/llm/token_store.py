"""Token-ID output by bit-plane shuffling.

A chunk file holds the ids of consecutive documents. Ids are dealt into blocks of ``block`` ids; each block is transposed
into bit planes (plane b holds bit b of every id), planes that are all zero are left out, and each other plane
is compressed by zstandard on its own. A chunk index at the end names the place and length of every plane
and the documents, so one block can be read without the others:

    b"BPS1" | planes ... | index (zstandard) | index length: 8 bytes | b"BPS1"

Chunks are carried as a binary column of a Parquet table in the shared folder, so any store
that Spark can write will do; ``save_local`` makes plain files of them.

Defined results: a null text is an empty one (its only id is the end id); null doc_ids come first; rows that repeat a
doc_id follow each other in the order of their texts; an empty table makes no chunk; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_ids import default_path, encoder
from .common import blocks, stored, tasks, text_of

MAGIC = b"BPS1"
BLOCK = 1 << 16
#: Ids in a chunk, about; a chunk ends with the document that reaches it.
CHUNK_IDS = 1 << 20


def pack_planes(ids: np.ndarray) -> list[bytes]:
    """The bit planes of a block of uint32 ids, lowest bit first, trailing zero planes left out."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    size = 2 if width <= 16 else 4
    bits = np.unpackbits(ids.astype(f"<u{size}").view(np.uint8).reshape(-1, size), axis=1, bitorder="little")
    return [x.tobytes() for x in np.packbits(np.ascontiguousarray(bits[:, :width].T), axis=1)]


def unpack_planes(planes: list[bytes], n: int) -> np.ndarray:
    size = 2 if len(planes) <= 16 else 4
    bits = np.zeros((8 * size, n), np.uint8)
    for i, p in enumerate(planes):
        bits[i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(f"<u{size}").reshape(-1).astype(np.uint32)


def write_chunk(ids: np.ndarray, docs: list[int | None], lengths: np.ndarray, block: int = BLOCK, level: int = 3) -> bytes:
    squeeze, body, places = zstandard.ZstdCompressor(level=level), [MAGIC], []
    at = len(MAGIC)
    for i in range(0, len(ids), block):
        planes = [squeeze.compress(p) for p in pack_planes(ids[i : i + block])]
        places.append((at, [len(p) for p in planes]))
        body += planes
        at += sum(map(len, planes))
    own = [struct.pack("<qqqq", len(ids), block, len(places), len(docs))]
    own += [struct.pack(f"<qi{len(x)}i", a, len(x), *x) for a, x in places]
    own += [np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], "u1").tobytes(), np.asarray(lengths, "<i8").tobytes()]
    index = squeeze.compress(b"".join(own))
    return b"".join([*body, index, struct.pack("<q", len(index)), MAGIC])


class Chunk:
    """Reads a chunk file; block(i) touches only the planes of block i."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC or raw[-4:] != MAGIC:
            raise ValueError("not a bit-plane chunk")
        (n,) = struct.unpack("<q", raw[-12:-4])
        own = zstandard.ZstdDecompressor().decompress(raw[-12 - n : -12])
        self.raw = raw
        self.n, self.size, n_blocks, n_docs = struct.unpack_from("<qqqq", own)
        at, self.places = 32, []
        for _ in range(n_blocks):
            a, k = struct.unpack_from("<qi", own, at)
            self.places.append((a, struct.unpack_from(f"<{k}i", own, at + 12)))
            at += 12 + 4 * k
        ids = np.frombuffer(own, "<i8", n_docs, at).tolist()
        null = np.frombuffer(own, "u1", n_docs, at + 8 * n_docs)
        self.docs = [None if x else d for d, x in zip(ids, null, strict=True)]
        self.lengths = np.frombuffer(own, "<i8", n_docs, at + 9 * n_docs)

    def block(self, i: int) -> np.ndarray:
        at, lengths = self.places[i]
        planes, out = [], zstandard.ZstdDecompressor()
        for n in lengths:
            planes.append(out.decompress(self.raw[at : at + n]))
            at += n
        return unpack_planes(planes, min(self.size, self.n - i * self.size))

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(len(self.places))] or [np.zeros(0, np.uint32)])


def _chunks(batches, path: str, end_id: int, chunk_ids: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    enc = encoder(path)
    docs: list = []
    ids: list[np.ndarray] = []
    lengths: list[int] = []
    held = 0
    for batch in batches:
        names = batch.column(0).to_pylist()
        for lo, hi, data, off in blocks(text_of(batch)):
            flat, at = enc.encode(data, off)
            flat = np.insert(flat, at[1:], end_id)
            at = at + np.arange(len(at))
            docs += names[lo:hi]
            lengths += np.diff(at).tolist()
            ids.append(flat)
            held += len(flat)
            if held >= chunk_ids:
                yield docs, np.concatenate(ids), np.array(lengths)
                docs, ids, lengths, held = [], [], [], 0
    if docs:
        yield docs, np.concatenate(ids), np.array(lengths)


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 0, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Chunks (part, seq, before, n_ids, chunk) of all documents in ascending doc_id order; part and seq order them, before is the number of
    ids in the part's chunks before. A null text has the end id only; an empty table makes no chunk."""
    path = path or default_path()

    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for seq, (names, ids, lengths) in enumerate(_chunks(batches, path, end_id, chunk_ids)):
            row = {"part": part, "seq": seq, "before": before, "n_ids": len(ids)}
            yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in row.items()} | {"chunk": pa.array([write_chunk(ids, names, lengths)], pa.binary())})
            before += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(tasks(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(run, "part long, seq long, before long, n_ids long, chunk binary"), "tokens")


def read_tokens(chunks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the chunks.

    A part's place among all ids is the sum of the parts before; there is a part for each task that wrote.
    """
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    above = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = F.broadcast(sizes.select("part", F.coalesce(above, F.lit(0)).alias("base")))

    def run(batches):
        for batch in batches:
            for base, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = Chunk(raw)
                ids, at = c.ids().astype("<u4"), np.concatenate([[0], np.cumsum(c.lengths)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.docs, pa.int64()), pa.array(at[:-1] + base), pa.array(c.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return chunks.join(places, "part").select((F.col("base") + F.col("before")).alias("base"), "chunk").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def save_local(chunks: DataFrame, folder: str) -> list[str]:
    """Plain files of the chunks, one at a time, in order."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for r in chunks.orderBy("part", "seq").toLocalIterator():
        out.append(os.path.join(folder, f"tokens-{r.part:06d}-{r.seq:06d}.bps"))
        with open(out[-1], "wb") as f:
            f.write(r.chunk)
    return out
