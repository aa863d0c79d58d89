"""Minimum-cost-flow resharding: new shard capacities at the fewest bytes moved.

Shards are laid out in files, and files in blocks of about a sixteenth: a block holds the documents of some hashes, or one long document, or a share of a
document that repeats too often for a block. The driver sees the sizes of blocks, a row for each 64 MB of the corpus (or 64 for each
shuffle partition, if that is more), and no text.

A minimum-cost flow from old shards to new ones (a byte that stays is free, a byte that moves costs 1) gives the bytes that each pair
exchanges. Whole files are then chosen to make up each amount, blocks of the few files that are left for the rest, and a last pass evens out what
whole blocks leave over. Only files that lose a block are rewritten, from those files alone and without a shuffle; all others stay as they are. A row's slot is
its block's place in the shard and its own in the block, so it takes no sorting either.

Law ``bytes``: shard sizes are as near to the mean as whole blocks allow.

Defined results: a null text has size 1 and checksum 0; a null doc_id hashes as such; a null old shard is shard 0; rows that repeat are rows
of their own; rows of one block are ordered by doc_id, checksum and size; an empty table leaves all shards empty; clashing
names don't matter, as only the named columns are read.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, shared_dir, stored

#: Blocks for each shuffle partition at least, blocks in a file, and bytes in a block at most.
FINENESS, PER_FILE, BLOCK = 64, 16, 64 << 20
#: Differences between shards that are left, as a share of one.
EVEN = 0.001


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest flow from sources to sinks that meets all demand: successive shortest paths with potentials.

    supply and demand have equal sums; cost(i, j) is not negative. The graph has one node for each shard.
    """
    m, n = len(supply), len(demand)
    s, t = m + n, m + n + 1
    graph: list[list[list]] = [[] for _ in range(m + n + 2)]

    def edge(a: int, b: int, cap: int, c: int) -> None:
        graph[a].append([b, cap, c, len(graph[b])])
        graph[b].append([a, 0, -c, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        edge(s, i, x, 0)
        for j in range(n):
            edge(i, m + j, x, cost(i, j))
    for j, x in enumerate(demand):
        edge(m + j, t, x, 0)
    high = [0] * len(graph)
    left = sum(supply)
    while left:
        dist = [math.inf] * len(graph)
        dist[s], via, queue = 0, {}, [(0, s)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for k, (b, cap, c, _) in enumerate(graph[a]):
                if cap and (e := d + c + high[a] - high[b]) < dist[b]:
                    dist[b], via[b] = e, (a, k)
                    heapq.heappush(queue, (e, b))
        if dist[t] == math.inf:
            raise ValueError("the capacities don't hold the rows")
        high = [h + (d if d < math.inf else 0) for h, d in zip(high, dist, strict=True)]
        push, b = left, t
        while b != s:
            a, k = via[b]
            push, b = min(push, graph[a][k][1]), a
        b = t
        while b != s:
            a, k = via[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
        left -= push
    return {(i, b - m): graph[b][back][1] for i in range(m) for b, _, _, back in graph[i] if m <= b < m + n and graph[b][back][1]}


def assign(blocks: list[tuple[int, int, int, int]], capacities: list[int]) -> dict[int, int]:
    """The new shard of each (block, old shard, bytes, file)."""
    total, n = sum(b[2] for b in blocks), len(capacities)
    share = [total * c // sum(capacities) for c in capacities]
    share[0] += total - sum(share)
    held: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    size_of, home, file_of = {}, {}, {}
    for block, old, size, file in blocks:
        held[old][file].append((size, block))
        size_of[block], home[block], file_of[block] = size, old, file
    olds = sorted(held)
    flow = min_cost_flow([sum(x[0] for f in held[o].values() for x in f) for o in olds], share, lambda i, j: 0 if olds[i] == j else 1)
    out: dict[int, int] = {}
    for i, o in enumerate(olds):
        want = {j: x for (k, j), x in flow.items() if k == i}
        left: list[tuple[int, int]] = []
        # whole files: first what stays, then the largest amounts
        for f in sorted(held[o], key=lambda f: (-sum(x[0] for x in held[o][f]), f)):
            size = sum(x[0] for x in held[o][f])
            fit = [j for j in want if want[j] >= size]
            if not fit:
                left += held[o][f]
                continue
            j = max(fit, key=lambda j: (j == o, want[j], -j))
            want[j] -= size
            out.update((block, j) for _, block in held[o][f])
        for size, block in sorted(left, key=lambda x: (-x[0], x[1])):
            j = max(want, key=lambda j: (want[j], j == o, -j)) if want else o % n
            want[j] = want.get(j, 0) - size
            out[block] = j
    now = [0] * n
    mine: list[dict[int, int]] = [{} for _ in range(n)]
    for block, j in out.items():
        now[j] += size_of[block]
        mine[j][block] = size_of[block]
    cut = {file_of[b] for b, j in out.items() if j != home[b]}
    off = lambda j: now[j] - share[j]
    for _ in range(4 * len(blocks)):
        a, b = max(range(n), key=off), min(range(n), key=off)
        gap = off(a) - off(b)
        if gap <= EVEN * total / n:
            break
        # one block across, or two blocks that change places: the amount nearest to half the gap; among the same, one that comes home
        # or whose file is rewritten anyway
        price = lambda x: (home[x] != b, file_of[x] not in cut, x)
        one = min((x for x in mine[a].items() if 0 < x[1] < gap), key=lambda x: (abs(gap - 2 * x[1]), price(x[0])), default=None)
        moves = [] if one is None else [(one[0], a, b)]
        if one is None or abs(gap - 2 * one[1]) > gap / 2:
            back = sorted((size, x) for x, size in mine[b].items())
            best = (True, 0, math.inf, 0, 0)  # what takes away half of the gap or more, in the fewest further files, by the fewest bytes
            for x, size in mine[a].items():
                i = bisect.bisect_left(back, (size - gap // 2, -1))
                for other, y in back[max(0, i - 1) : i + 1]:
                    d = size - other
                    if 0 < d < gap and (found := (abs(gap - 2 * d) > gap / 2, (file_of[x] not in cut) + (file_of[y] not in cut), size + other, x, y)) < best and (one is None or not found[0]):
                        best, moves = found, [(x, a, b), (y, b, a)]
        if not moves:
            break
        for x, p, q in moves:
            mine[q][x] = mine[p].pop(x)
            now[p], now[q], out[x] = now[p] - size_of[x], now[q] + size_of[x], q
            cut.add(file_of[x])
    return out


COLUMNS = ["doc_id", "text", "size", "text_crc32", "old_shard", "block", "row"]


def lay_out(docs: DataFrame, old_shard: Column) -> str:
    """Writes docs as shards are found before a change: a folder for each file, whose rows have their block and their place in it. Returns the path."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"))
    light = sized.select("doc_id", "size", "text_crc32", "old_shard")
    per = [(r.old_shard, r.b) for r in light.groupBy("old_shard").agg(F.sum("size").alias("b")).collect()]
    goal = max(1, min(BLOCK, sum(b for _, b in per) // (FINENESS * partitions(spark))))
    counts = F.broadcast(spark.createDataFrame([(o, math.ceil(b / goal / PER_FILE)) for o, b in per], "old_shard int, files long"))  # a row for each shard
    # rows that repeat beyond a block's size: at most as many as there are blocks
    same = ["old_shard", "doc_id", "text_crc32", "size"]
    often = stored(light.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * F.col("size") > goal).select(*(F.col(c).alias(f"_{c}") for c in same)), "often")
    match = F.lit(True)
    for c in same:
        match &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = sized.join(counts, "old_shard").withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(often), match, "left")
    salt = F.when(F.col("_old_shard").isNotNull(), F.col("_at")).otherwise(F.lit(0).cast("long"))
    hashed = F.xxhash64("doc_id", "text_crc32", salt)
    # a block's id: the old shard, whether it is one document, its hash; a file's: the old shard, and the blocks by sixteens
    bucket = F.pmod(hashed, F.col("files") * PER_FILE)
    key = F.when(F.col("size") > goal, F.xxhash64("doc_id", "text_crc32", salt, F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1)) + F.lit(1 << 40)).otherwise(bucket)
    above = F.shiftleft(F.col("old_shard").cast("long"), 44)
    placed = rows.withColumns({"block": above + key, "file": above + F.floor(bucket / PER_FILE).cast("long")})
    order = Window.partitionBy("file", "block").orderBy("doc_id", "text_crc32", "size")
    deal = max(1, min(sum(math.ceil(b / goal / PER_FILE) for _, b in per), 4 * partitions(spark) + sum(b for _, b in per) // (BLOCK * PER_FILE)))
    out = placed.repartition(deal, "file").withColumn("row", F.row_number().over(order) - 1)
    path = shared_dir(spark, "layout")
    out.select(*COLUMNS, "file").write.partitionBy("file").parquet(path)
    return path


_SCHEMA = "doc_id long, text string, size long, text_crc32 long, old_shard int, block long, row int"


def rewrite(spark, path: str, capacities: list[int]) -> tuple[DataFrame, dict]:
    """Moves what must move of the shards laid out at path to new shards, and returns the table, and what was moved and rewritten.

    Columns: doc_id, text, size, text_crc32, old_shard, shard, slot. Files without a block that moves are read where they are.
    """
    n = len(capacities)
    old = spark.read.schema(_SCHEMA + ", file long").parquet(path)
    sums = old.groupBy("block", "old_shard", "file").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    place = assign([(r.block, r.old_shard, r.bytes, r.file) for r in sums], capacities)
    cut = sorted({r.file for r in sums if place[r.block] != r.old_shard})
    base, slots = [0] * n, []
    for r in sorted(sums, key=lambda r: (place[r.block], r.file, r.block)):
        j = place[r.block]
        slots.append((r.block, r.file, j, base[j]))
        base[j] += r.rows
    where = F.broadcast(spark.createDataFrame(slots, "block long, file long, shard int, base long"))  # a row for each block

    def files(names: list[int]) -> DataFrame:
        if not names:
            return spark.createDataFrame([], _SCHEMA + ", file long")
        return spark.read.schema(_SCHEMA + ", file long").option("basePath", path).parquet(*(f"{path}/file={f}" for f in names))

    moved = stored(files(cut).join(where, ["block", "file"]).select(*COLUMNS, "base", "shard", "file"), "rewritten", ["shard", "file"])
    stay = files(sorted({r.file for r in sums} - set(cut))).join(where, ["block", "file"])
    cols = ["doc_id", "text", "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("row")).alias("slot")]
    done = {
        "total": sum(r.bytes for r in sums), "moved": sum(r.bytes for r in sums if place[r.block] != r.old_shard), "rewritten": sum(r.bytes for r in sums if r.file in set(cut)),
        "files": len({r.file for r in sums}), "files_rewritten": len(cut), "sizes": [sum(r.bytes for r in sums if place[r.block] == j) for j in range(n)], "blocks": len(sums),
    }
    return stay.select(*cols).unionByName(moved.select(*cols)), done


def reshard(docs: DataFrame, old_shard: Column, capacities: list[int]) -> tuple[DataFrame, dict]:
    """Lays docs out in their old shards, and moves what must move to the new ones."""
    return rewrite(docs.sparkSession, lay_out(docs, old_shard), capacities)


def write_shards(table: DataFrame, path: str | None = None) -> str:
    """Copies a resharded table to a folder, one directory for each shard."""
    path = path or shared_dir(table.sparkSession, "shards")
    table.write.mode("overwrite").partitionBy("shard").parquet(path)
    return path
