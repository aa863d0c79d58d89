"""Flat binary token files as a Spark data source: little-endian ids, perhaps a byte of mask for each, and a metadata file, in order of start_pos.

Reading takes only the byte ranges that are asked for: filters on start_pos are pushed down to the rows (of block ids) that satisfy them, and a partition has
ranges of split ids in all, whether they are a part of a file or scattered over it. windows() reads exactly the bytes of each of any number of windows.
The folder has to be one that the driver and all executors mount: Spark hands its own file systems to no Python data source.
"""

from __future__ import annotations

import bisect
import json
import os
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)


@dataclass
class Wrote(WriterCommitMessage):
    file: str | None
    start: int
    n: int


@dataclass
class Part(InputPartition):
    """Ranges of positions of one file, each from the start of a row to the end of one."""

    file: str
    start: int
    ranges: list[tuple[int, int]]


def _folder(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


class TokenBin(DataSource):
    """format("token_bin"): writes rows (start_pos long, ids array<int>[, mask array<int>]); reads such rows of up to block ids.

    Rows of a partition must come in order of start_pos: range-partition by it and sort within partitions. Options: path (a folder that all
    executors share), dtype (uint16 or uint32), block, split (ids of a partition, about), eot_id, vocab_size, masked (true: a mask file beside each token file).
    A row starts at each block ids from the start of its file.
    """

    @classmethod
    def name(cls) -> str:
        return "token_bin"

    def _masked(self) -> bool:
        return str(self.options.get("masked", "false")).lower() == "true"

    def schema(self) -> str:
        return "start_pos long, ids array<int>" + ", mask array<int>" * self._masked()

    def writer(self, schema, overwrite: bool):
        return _Writer(dict(self.options), overwrite, self._masked())

    def reader(self, schema):
        return _Reader(dict(self.options), self._masked())


def _mask_of(file: str) -> str:
    return file.removesuffix(".bin") + ".mask"


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool, masked: bool):
        self.path, self.options, self.masked = _folder(options["path"]), options, masked
        self.dtype = np.dtype(options.get("dtype", "uint16")).newbyteorder("<")
        if overwrite and os.path.isdir(self.path):
            for f in os.listdir(self.path):
                if f.endswith((".bin", ".mask", ".json")):
                    os.remove(os.path.join(self.path, f))

    def write(self, batches):
        """A batch at a time, as it comes."""
        from pyspark import TaskContext

        c, first, at, out, name = TaskContext.get(), 0, 0, [], None
        try:
            for b in batches:
                for k in range(b.num_rows):
                    start, ids = b.column(0)[k].as_py(), b.column(1)[k].values.to_numpy(zero_copy_only=False)
                    if name is None:
                        first = at = start
                        os.makedirs(self.path, exist_ok=True)
                        name = f"tokens-{start:016d}-{c.partitionId():05d}-{c.taskAttemptId()}.bin"
                        out = [open(os.path.join(self.path, x), "wb") for x in [name, *[_mask_of(name)] * self.masked]]
                    if start != at:
                        raise ValueError("the rows of a partition must follow each other; range-partition and sort by start_pos")
                    if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
                        raise ValueError(f"the id {int(ids.max())} doesn't fit in {self.dtype.name}")
                    out[0].write(ids.astype(self.dtype).tobytes())
                    if self.masked:
                        mask = b.column(2)[k].values.to_numpy(zero_copy_only=False)
                        if len(mask) != len(ids):
                            raise ValueError(f"a mask of {len(mask)} for {len(ids)} tokens")
                        out[1].write(mask.astype(np.uint8).tobytes())
                    at += len(ids)
        finally:
            for f in out:
                f.close()
        return Wrote(name, first, at - first)

    def commit(self, messages):
        parts = sorted((m.start, m.n, m.file) for m in messages if m and m.file)
        os.makedirs(self.path, exist_ok=True)
        meta = {"dtype": self.dtype.name, "masked": self.masked, "files": [[f, s, n] for s, n, f in parts], "n_tokens": sum(n for _, n, _ in parts)}
        meta |= {k: int(self.options[k]) for k in ("eot_id", "vocab_size") if k in self.options}
        with open(os.path.join(self.path, "meta.json"), "w") as f:
            json.dump(meta, f)

    def abort(self, messages):
        for m in messages:
            if m and m.file:
                for x in (m.file, _mask_of(m.file)):
                    if os.path.exists(os.path.join(self.path, x)):
                        os.remove(os.path.join(self.path, x))


def metadata(path: str) -> dict:
    """The folder's metadata; files: (name, first position, ids) in order."""
    with open(os.path.join(_folder(path), "meta.json")) as f:
        return json.load(f)


def _kind(meta: dict) -> np.dtype:
    return np.dtype(meta["dtype"]).newbyteorder("<")


def _ids(path: str, kind: np.dtype, first: int, n: int) -> np.ndarray:
    """n ids of a file from its first-th on: one read of their bytes."""
    out = np.fromfile(path, dtype=kind, count=n, offset=first * kind.itemsize) if n else np.zeros(0, kind)
    if len(out) < n:
        raise ValueError(f"{path} ends {n - len(out)} tokens too early")
    return out


class _Asked:
    """What the filters on start_pos leave: bounds, and perhaps a set of values."""

    def __init__(self):
        self.low, self.high, self.values = 0, 1 << 62, None

    def take(self, f: Filter) -> bool:
        """Whether the filter is one that the reader applies by itself."""
        if getattr(f, "attribute", None) != ("start_pos",):
            return False
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, In):
            self._among(x for x in f.value if x is not None)
        elif isinstance(f, EqualTo) and f.value is not None:
            self._among([f.value])
        elif isinstance(f, GreaterThan) and f.value is not None:
            self.low = max(self.low, f.value + 1)
        elif isinstance(f, GreaterThanOrEqual) and f.value is not None:
            self.low = max(self.low, f.value)
        elif isinstance(f, LessThan) and f.value is not None:
            self.high = min(self.high, f.value - 1)
        elif isinstance(f, LessThanOrEqual) and f.value is not None:
            self.high = min(self.high, f.value)
        else:
            return False
        return True

    def _among(self, values) -> None:
        self.values = set(values) if self.values is None else self.values & set(values)

    def ranges(self, start: int, n: int, block: int) -> list[tuple[int, int]]:
        """The ranges of positions of a file's rows that are asked for, neighbours as one."""
        if self.values is None:
            first = max(0, -(-(self.low - start) // block))
            end = min(-(-n // block), (self.high - start) // block + 1)
            return [(start + first * block, min(start + n, start + end * block))] if first < end else []
        out: list[tuple[int, int]] = []
        for v in sorted(v for v in self.values if start <= v < start + n and self.low <= v <= self.high and not (v - start) % block):
            end = min(start + n, v + block)
            if out and out[-1][1] == v:
                out[-1] = (out[-1][0], end)
            else:
                out.append((v, end))
        return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict, masked: bool):
        self.path, self.block, self.masked = _folder(options["path"]), int(options.get("block", 1 << 16)), masked
        self.split = max(self.block, int(options.get("split", 1 << 24)))
        self.meta, self.asked = metadata(self.path), _Asked()
        least = int(options.get("seq_len", 0)) + 1
        if self.meta["n_tokens"] < least:
            raise ValueError(f"{self.meta['n_tokens']} tokens are fewer than {least}")
        if masked:
            if not self.meta.get("masked"):
                raise ValueError("the files have no masks")
            wide = _kind(self.meta).itemsize
            for f, _, _ in self.meta["files"]:
                n, m = (os.path.getsize(os.path.join(self.path, x)) for x in (f, _mask_of(f)))
                if n // wide != m:
                    raise ValueError(f"{f}: {n // wide} tokens, a mask of {m}")

    def pushFilters(self, filters):
        return [f for f in filters if not self.asked.take(f)]

    def partitions(self):
        """Each of about split ids; a long range is cut at rows."""
        out, step = [], self.split // self.block * self.block
        for file, start, n in self.meta["files"]:
            held: list[tuple[int, int]] = []
            for first, end in self.asked.ranges(start, n, self.block):
                for at in range(first, end, step):
                    held.append((at, min(end, at + step)))
                    if sum(b - a for a, b in held) >= self.split:
                        out.append(Part(file, start, held))
                        held = []
            if held:
                out.append(Part(file, start, held))
        return out

    def read(self, part: Part):
        if not isinstance(part, Part):  # nothing is asked for
            return
        kinds = [(part.file, _kind(self.meta)), *[(_mask_of(part.file), np.dtype("u1"))] * self.masked]
        names = ["start_pos", "ids", *["mask"] * self.masked]
        for first, end in part.ranges:
            for at in range(first, end, self.block * 16):  # sixteen rows at once
                n = min(end - at, self.block * 16)
                starts = np.arange(0, n, self.block)
                offsets = pa.array(np.append(starts, n), pa.int32())
                cols = [pa.ListArray.from_arrays(offsets, pa.array(_ids(os.path.join(self.path, f), kind, at - part.start, n).astype(np.int32))) for f, kind in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(starts + at, pa.int64()), *cols], names)


def row_starts(path: str, offsets: list[int], length: int, block: int = 1 << 16) -> list[int]:
    """The start_pos of the rows that windows of length + 1 ids from these offsets touch: a filter on them reads no other bytes."""
    files = metadata(path)["files"]
    first = [s for _, s, _ in files]
    out: set[int] = set()
    for off in offsets:
        k = max(0, bisect.bisect_right(first, off) - 1)
        while k < len(files) and files[k][1] <= off + length:
            _, s, n = files[k]
            low, high = max(off, s), min(off + length, s + n - 1)
            out.update(range(s + (low - s) // block * block, high + 1, block))
            k += 1
    return sorted(out)


def _cutter(path: str):
    """(meta, read): read(first position, n, mask) takes n ids, or their masks, from as many files as they lie in."""
    folder = _folder(path)
    meta = metadata(folder)
    files, first = meta["files"], [s for _, s, _ in meta["files"]]

    def read(off: int, n: int, mask: bool = False) -> np.ndarray:
        kind, name = (np.dtype("u1"), _mask_of) if mask else (_kind(meta), str)
        k, parts = max(0, bisect.bisect_right(first, off) - 1), [np.zeros(0, np.int32)]
        while n and k < len(files):
            file, s, m = files[k]
            take = max(0, min(n, s + m - off))
            parts.append(_ids(os.path.join(folder, name(file)), kind, off - s, take).astype(np.int32))
            off, n, k = off + take, n - take, k + 1
        return np.concatenate(parts)

    return meta, read


def spans(asked: DataFrame, path: str) -> DataFrame:
    """(key, ids) of (key, offset, n): each task reads the bytes of its own spans, whatever their number. Spans that the stream doesn't hold whole and null
    ones are left out."""
    meta, read = _cutter(path)

    def run(batches):
        for batch in batches:
            rows = [(k, o, n) for k, o, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if o is not None and n is not None and 0 <= o <= o + n <= meta["n_tokens"]]
            ends = np.cumsum([n for _, _, n in rows], dtype=np.int64)
            lo = 0
            while lo < len(rows):  # about a million ids at once
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows[lo:hi]], pa.int64()), pa.array([read(o, n) for _, o, n in rows[lo:hi]], pa.list_(pa.int32()))], ["key", "ids"])
                lo = hi

    return asked.select(*(F.col(c).cast("long").alias(c) for c in ("key", "offset", "n"))).mapInArrow(run, "key long, ids array<int>")


def windows(offsets: DataFrame, path: str, length: int, masked: bool = False) -> DataFrame:
    """(window, x, y[, m]) of (window, offset): each task reads the bytes of its own windows of length + 1 ids, and nothing else; there is no join, no shuffle and
    no bound on the number of windows. Windows that begin before the first or end after the last token are left out, as are null offsets. m goes with y."""
    meta, read = _cutter(path)

    def run(batches):
        for batch in batches:
            at = [(w, o) for w, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if o is not None and 0 <= o <= meta["n_tokens"] - length - 1]
            ids = np.array([read(o, length + 1) for _, o in at], np.int32).reshape(-1, length + 1)
            rows = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * length + 1, length, dtype=np.int32)), pa.array(np.ascontiguousarray(x).reshape(-1)))
            cols = [pa.array([w for w, _ in at], pa.int64()), rows(ids[:, :-1]), rows(ids[:, 1:])]
            if masked:
                cols.append(rows(np.array([read(o, length + 1, True) for _, o in at], np.int32).reshape(-1, length + 1)[:, 1:]))
            yield pa.RecordBatch.from_arrays(cols, ["window", "x", "y", *["m"] * masked])

    asked = offsets.select(F.col("window").cast("long").alias("window"), F.col("offset").cast("long").alias("offset"))
    return asked.mapInArrow(run, "window long, x array<int>, y array<int>" + ", m array<int>" * masked)


def install(spark: SparkSession) -> None:
    """Registers the source, and lets the session push filters into Python sources."""
    spark.dataSource.register(TokenBin)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
