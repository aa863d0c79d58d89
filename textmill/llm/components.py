"""Connected components by contraction, in DataFrame operations, and sorted group iteration for Arrow maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); root is one node of the component.

    Each round maps every node to the smallest of itself and its neighbours and contracts the graph. Node ids are hashes, so a
    round keeps a constant share of the nodes at most in expectation, and stars vanish at once. Every round is a stored table.
    """
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(edges.select("b", "a"))
        low = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("root")), "roots")
        maps.append(low)
        ends = edges.join(low.withColumnsRenamed({"node": "a", "root": "ra"}), "a").join(low.withColumnsRenamed({"node": "b", "root": "rb"}), "b")
        edges = stored(ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for low in maps[1:]:
        further = low.select(F.col("node").alias("root"), F.col("root").alias("further"))
        out = out.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return stored(out, "components") if len(maps) > 1 else out


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each of n nodes' components, from edges of indexes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    return label


def groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """Tables of whole runs of equal values of the first key columns, of a partition sorted by them.

    A table holds one or more groups: all that end within a batch come at once.
    """
    held: list[pa.RecordBatch] = []

    def last_start(batch: pa.RecordBatch) -> int:
        cut = 0
        for i in range(keys):
            col = batch.column(i).to_numpy(zero_copy_only=False)
            cut = max(cut, int(np.flatnonzero(col != col[-1])[-1]) + 1 if (col != col[-1]).any() else 0)
        return cut

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        cut = last_start(batch)
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
