"""A folder of line shards as a Spark source, batch or streaming, whose offsets are (shard, byte).

Shards are the folder's files in order of their paths; new ones come after all others, and the last may still grow. A range of bytes has the lines that begin in
it, so offsets need not fall on line ends, no line is read twice, and tasks share a shard by ranges of ``split`` bytes. The budget ends the source at the line
that reaches it, as a byte budget does. Lines of the last shard that have no line feed yet are left for later.

A micro-batch has all that is new, in bounded ranges; the state of a query is its checkpointed offset alone, so one that is stopped goes on where it was.
The folder has to be one that the driver and all executors mount.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


@dataclass
class Lines(InputPartition):
    """The lines of a shard that begin from byte first on and before byte end."""

    shard: str
    first: int
    end: int


def _whole(path: str, size: int, step: int = 1 << 20) -> int:
    """The bytes up to the last line feed."""
    with open(path, "rb") as f:
        while size > 0:
            at = max(0, size - step)
            f.seek(at)
            if (k := f.read(size - at).rfind(b"\n")) >= 0:
                return at + k + 1
            size = at
    return 0


class Shards:
    """The shards of a folder as one run of bytes."""

    def __init__(self, options: dict):
        path = options["path"]
        self.path = urlparse(path).path if path.startswith("file:") else path
        self.suffix, self.budget = tuple(options.get("suffix", ".json,.jsonl").split(",")), int(options.get("budget", 1 << 62))
        self.split = max(1, int(options.get("split", 32 << 20)))

    def sizes(self) -> list[tuple[str, int]]:
        """(shard, bytes) in order."""
        found = [os.path.relpath(os.path.join(d, f), self.path) for d, _, names in os.walk(self.path) for f in names if f.endswith(self.suffix) and f[0] not in "._"]
        return [(f, os.path.getsize(os.path.join(self.path, f))) for f in sorted(found)]

    def end(self, growing: bool) -> dict:
        """The offset after all that there is, or after the budget."""
        sizes, before = self.sizes(), 0
        at = {"shard": "", "byte": 0}
        for i, (f, n) in enumerate(sizes):
            if growing and i == len(sizes) - 1:
                n = _whole(os.path.join(self.path, f), n)
            at = {"shard": f, "byte": min(n, self.budget - before)}
            before += n
            if before >= self.budget:
                break
        return at

    def between(self, start: dict, end: dict) -> list[Lines]:
        """Ranges of split bytes of the shards from one offset to another."""
        out = []
        for f, n in self.sizes():
            first = 0 if f > start["shard"] else start["byte"] if f == start["shard"] else n
            last = n if f < end["shard"] else end["byte"] if f == end["shard"] else 0
            out += [Lines(f, a, min(last, a + self.split)) for a in range(first, last, self.split)]
        return out

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Lines):  # there is nothing
            return
        at, lines = [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part.shard] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(lines, pa.string())], ["shard", "byte", "line"])

        with open(os.path.join(self.path, part.shard), "rb") as f:
            pos = max(0, part.first - 1)
            f.seek(pos)
            if part.first:
                pos += len(f.readline())  # the line that begins before, or the line feed before the first
            size = 0
            while pos < part.end and (line := f.readline()):
                at.append(pos)
                lines.append(line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                pos, size = pos + len(line), size + len(line)
                if size > 4 << 20:
                    yield batch()
                    at, lines, size = [], [], 0
        yield batch()


class ShardLines(DataSource):
    """format("shard_lines"): rows (shard string, byte long, line string). Options: path, suffix (endings, comma-joined), budget and split in bytes."""

    @classmethod
    def name(cls) -> str:
        return "shard_lines"

    def schema(self) -> str:
        return "shard string, byte long, line string"

    def reader(self, schema):
        return _Batch(dict(self.options))

    def streamReader(self, schema):
        return _Stream(dict(self.options))


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.shards = Shards(options)

    def partitions(self):
        return self.shards.between({"shard": "", "byte": 0}, self.shards.end(growing=False))

    def read(self, part):
        yield from self.shards.read(part)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.shards = Shards(options)

    def initialOffset(self) -> dict:
        return {"shard": "", "byte": 0}

    def latestOffset(self) -> dict:
        return self.shards.end(growing=True)

    def partitions(self, start: dict, end: dict):
        return self.shards.between(start, end)

    def read(self, part):
        yield from self.shards.read(part)

    def commit(self, end: dict) -> None:
        pass


def install(spark: SparkSession) -> None:
    spark.dataSource.register(ShardLines)
