"""Best-fit packing with certified bounds.

Documents become token pieces of at most ``capacity`` ids: only longer documents are cut, and of those the
first piece takes the remainder. Pieces are dealt into partitions; each runs best-fit decreasing, and
dual-feasible functions give a lower bound of its bin count. A partition that meets its bound is certified
and stays. Partitions with a gap give up their bins that are not full, exchange those pieces with other
such partitions (up to four are merged, while they hold no more than eight partitions' pieces), and run best-fit decreasing again, until no gap
is left, no two can be merged, or a round saves nothing.

Defined results: a null text is an empty one, a document of one id (the end id); repeated rows are documents of their own;
an empty table makes no piece; other columns are not read. Ties go by length, doc_id, piece and checksum, so equal
inputs get equal packings, whatever the order of rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_ids import default_path, encoder
from .common import blocks, settle, stored, text_of

CAPACITY = 1024
#: Pieces in a partition, about; what one task packs at a time.
PARTITION_PIECES = 60_000
#: Partitions that exchange pieces in a round, and the partitions' pieces that they may hold together.
MERGE, MOST = 4, 8


def pieces_of(docs: DataFrame, path: str | None = None, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents; with_ids adds the ids as little-endian uint32."""
    path = path or default_path()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            col = text_of(batch)
            for lo, hi, data, off in blocks(col):
                flat, at = enc.encode(data, off)
                flat = np.insert(flat, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                n = np.diff(at)
                count = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                a = at[:-1][row] + start
                crc = [zlib.crc32(flat[i:j]) for i, j in zip(a.tolist(), (a + length).tolist(), strict=True)]
                cols = [batch.column(0).take(pa.array(row + lo)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([flat[i:j].tobytes() for i, j in zip(a.tolist(), (a + length).tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of the volume bound and two families of dual-feasible functions.

    u_k rounds (k+1)x down to k-ths unless it is whole; f_t lifts sizes above 1-t to 1 and drops those below t.
    """
    hist = np.bincount(lengths, minlength=capacity + 1)
    s = np.flatnonzero(hist)
    if not len(s):
        return 0
    w = hist[s]
    best = -(-int((s * w).sum()) // capacity)
    for k in range(1, 25):
        whole = (k + 1) * s % capacity == 0
        scaled = np.where(whole, s * k, (k + 1) * s // capacity * capacity)
        best = max(best, -(-int((scaled * w).sum()) // (k * capacity)))
    for t in s[s <= capacity // 2]:
        lifted = np.where(s > capacity - t, capacity, np.where(s < t, 0, s))
        best = max(best, -(-int((lifted * w).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and offset of each length (in the given order, which must descend), and the fill of each bin.

    Open bins are kept by free space; a bit mask of the spaces in use finds the tightest in constant time.
    """
    bins, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, n in enumerate(lengths.tolist()):
        m = mask >> n
        if m:
            space = n + (m & -m).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            b, space = len(fill), capacity
            fill.append(0)
        bins[i], offset[i] = b, fill[b]
        fill[b] += n
        if space > n:
            free[space - n].append(b)
            mask |= 1 << (space - n)
    return bins, offset, np.array(fill, np.int64)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long, part long, bins long, bound long"


def _pack(level: int, capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        settle()
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        b, at, fill = best_fit_decreasing(pdf.length.to_numpy(), capacity)
        part = int(pdf.part.iloc[0])
        out = pdf[COLUMNS].copy()
        out["sequence_id"], out["offset"], out["fill"] = (level << 58) + (part << 32) + b, at, fill[b]
        out["part"], out["bins"], out["bound"] = part, len(fill), lower_bound(pdf.length.to_numpy(), capacity)
        return out

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> tuple[DataFrame, dict]:
    """The pieces with sequence_id and offset, and what the certificates say.

    pieces must be a stored table: it is read twice.
    """
    n = pieces.count()
    parts = max(1, math.ceil(n / partition_pieces))
    # pieces that repeat beyond a share of a partition are dealt one by one; they are ten for each partition at most
    key = ["doc_id", "piece", "ids_crc32"]
    often = stored(pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(1, partition_pieces // 10)).select(*(F.col(c).alias(f"_{c}") for c in key)), "often")
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    hashed = F.xxhash64(*key, F.when(F.col("_piece").isNotNull(), F.col("_at")).otherwise(F.lit(0).cast("long")))
    dealt = pieces.withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(often), same, "left")
    dealt = dealt.withColumn("part", F.pmod(hashed, F.lit(parts)).cast("long")).select(*COLUMNS, "part")
    packed = stored(dealt.groupBy("part").applyInPandas(_pack(0, capacity), _SCHEMA), "packed")
    summary = {"pieces": n, "partitions": parts, "rounds": 0}

    def totals(df: DataFrame) -> list[tuple[int, int, int, int]]:
        """(part, bins, bound, pieces in bins that aren't full): a row for each partition_pieces pieces."""
        return [tuple(r) for r in df.groupBy("part").agg(F.max("bins"), F.max("bound"), F.count_if(F.col("fill") < capacity)).collect()]

    done: list[DataFrame] = []
    now, level = totals(packed), 0
    while True:
        # consecutive partitions with a gap make a group while their loose pieces are few enough for a task
        groups: list[tuple[int, int]] = []
        held, members, group = 0, 0, -1
        for part, bins, bound, loose in sorted(now):
            if bins <= bound:
                continue
            if group < 0 or members == MERGE or held + loose > MOST * partition_pieces:
                held, members, group = 0, 0, group + 1
            groups.append((part, group))
            held, members = held + loose, members + 1
        if not groups or group + 1 == len(groups):
            break
        level += 1
        gap = packed.filter("bins > bound")
        pool = gap.filter(F.col("fill") < capacity)
        table = F.broadcast(pieces.sparkSession.createDataFrame(groups, "part long, group long"))
        again = stored(pool.join(table, "part").drop("part").withColumnRenamed("group", "part").groupBy("part").applyInPandas(_pack(level, capacity), _SCHEMA), "repacked")
        before = pool.select("sequence_id").distinct().count()
        after = totals(again)
        summary["rounds"] = level
        if sum(x[1] for x in after) >= before:
            break
        done += [packed.filter("bins <= bound"), gap.filter(F.col("fill") >= capacity)]
        packed, now = again, after
    done.append(packed)
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select(*COLUMNS, "sequence_id", "offset"), summary


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Cuts and packs all documents."""
    return pack(stored(pieces_of(docs, path, capacity=capacity), "pieces"), capacity)[0]
