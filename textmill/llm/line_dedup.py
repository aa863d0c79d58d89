"""Line dedup by a segment-partition edit join.

Lines are the parts of a text between line feeds, stripped of surrounding white space. A line goes if an equal line comes earlier (by
doc_id, then row, then line number), whatever its length, or if its text is within ``tau`` edits (code points inserted, deleted or replaced) of
a text that comes earlier; only texts of ``min_chars`` code points or more are compared by edits.

1. Every line is hashed and placed; equal lines meet by their hash (XXH64, the same in Spark and in Python).
2. Each different line is split into tau + 1 even segments. Two lines within tau edits share some segment of the shorter one,
   at a place that the multi-match-aware window bounds, so a line is entered under (its length, segment number, segment) and probes
   (length, number, substring) for every length down to tau less. Keys are 64-bit hashes; they are shuffled, not texts, in runs for each bucket.
3. Keys that an entered line and another one share make groups. Lines of groups get their texts back: a Bloom map of bounded size picks the
   rows and lines, and a join takes out what passed it by chance.
4. Groups are verified pair by pair with a banded bit-parallel edit distance, vectorised over pairs, after a character count
   filter. Large groups are dealt to tasks in pairs of blocks. What leaves a task is at most a row for each line.

There is one plan for every size. Lines with so many copies that one task would hold more than its share are joined by broadcast: they
are at most as many as there are tasks.

A document loses the lines that go. Defined results: a null text is an empty one and has no line; a document without doc_id comes after all others;
rows that repeat both doc_id and text count as one document, so they keep the same lines, and rows of one doc_id and other texts follow
each other by their hash; lines without a solid character stay; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Bloom, SpanHasher, blocks, code_points, join_unique, mix, row_hash, settle, stored, tasks, text_of
from .components import components, groups, local_components


@dataclass(frozen=True)
class LineParams:
    """tau: edits. min_chars: code points from which lines are compared by edits. block: lines of a group that a task compares with as many others."""

    tau: int = 2
    min_chars: int = 24
    block: int = 1024


def lines_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each stripped line with a solid character, its row, and its number in the row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    edge[0] = True
    begin = edge[:n].copy()
    begin[1:] |= data[:-1] == 10
    first = np.flatnonzero(begin)
    stop = np.append(first[1:], n)
    row = np.searchsorted(off, first, "right") - 1
    # a text of k line feeds has k + 1 lines, of which the last may be empty and is not seen here
    number = np.arange(len(first)) - np.searchsorted(row, row)
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = solid[stop] > solid[first]
    first, stop, row, number = first[full], stop[full], row[full], number[full]
    place = np.flatnonzero(~SPACE[data])
    start = place[solid[first]]
    end = place[solid[stop] - 1] + 1
    return start, end, row, number


class Points:
    """Hashes of code point ranges of a block, over their bytes."""

    def __init__(self, data: np.ndarray):
        self.place = np.append(np.flatnonzero(code_points(data)), len(data))
        self.hasher = SpanHasher(data)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.hasher.spans(self.place[start], self.place[end])


class Lines:
    """The lines of a block that are compared by edits: bytes, row, XXH64 as Spark has it, and each different one's first index."""

    def __init__(self, data: np.ndarray, off: np.ndarray, p: LineParams):
        first, stop, row, _ = lines_of(data, off)
        at = np.concatenate([[0], np.cumsum(code_points(data))])
        long = at[stop] - at[first] >= p.min_chars
        self.row, first, stop = row[long], first[long], stop[long]
        self.start, self.end = at[first], at[stop]
        raw = data.tobytes()
        self.raw = [raw[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
        self.hash = np.array([xxhash.xxh64_intdigest(x, 42) for x in self.raw], np.uint64).view(np.int64)


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and length of segment i of even partitions; the last ones are longer by one."""
    base, extra = length // parts, length % parts
    longer = np.maximum(i - (parts - extra), 0)
    return i * base + longer, base + (i >= parts - extra)


def keys_of(points: Points, start: np.ndarray, end: np.ndarray, h: np.ndarray, p: LineParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line hash, entered) of the lines from start to end: entered keys also probe."""
    size = end - start
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for less in range(p.tau + 1):
        length = size - less
        for i in range(p.tau + 1):
            at, n = segment(length, i, p.tau + 1)
            low = np.maximum(np.maximum(at - i, at + less - (p.tau - i)), 0)
            high = np.minimum(np.minimum(at + i, at + less + (p.tau - i)), size - n)
            for step in range(2 * p.tau + 1):
                ok = (low + step <= high) & (n > 0)
                if not ok.any():
                    break
                a = start[ok] + low[ok] + step
                salt = mix((length[ok] * (p.tau + 1) + i).astype(np.uint64) + np.uint64(0xABCD))
                key = mix(points.spans(a, a + n[ok]) + salt)
                out.append((key.view(np.int64), h[ok], (low[ok] + step == at[ok]) & (less == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def edit_distances(pattern: np.ndarray, text: np.ndarray, m: np.ndarray, n: np.ndarray, tau: int) -> np.ndarray:
    """Edit distances of pairs, or more than tau where they are more.

    pattern, text: code points, a row for each pair, padded by values that differ; m, n: their lengths, m > tau and |m - n| <= tau.
    Bit 63 stands for pattern row j + tau of text column j, so the band slides down with the text; the score follows the
    band's lower edge, then the last row.
    """
    one, top = np.uint64(1), np.uint64(63)
    k = len(m)
    vp, vn = np.full(k, ~np.uint64(0) << np.uint64(63 - tau), np.uint64), np.zeros(k, np.uint64)
    score = np.full(k, tau, np.int64)
    width = pattern.shape[1]
    out = np.full(k, tau + 1, np.int64)
    live = np.arange(k)
    for j in range(int(n.max(initial=0))):
        x = np.zeros(len(live), np.uint64)
        c = text[:, j]
        for i in range(max(0, j - tau), min(width, j + tau + 1)):
            x |= (pattern[:, i] == c).astype(np.uint64) << np.uint64(63 - (j + tau - i))
        d = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d | vp), d & vp
        edge = j < m - tau
        bit = np.where(edge, top, np.uint64(0))
        last = ~edge
        bit[last] = (62 - (j - (m[last] - tau))).astype(np.uint64)
        score += np.where(edge, 1 - ((d >> bit) & one).astype(np.int64), ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
        vp, vn = hn | ~((d >> one) | hp), (d >> one) & hp
        done = n == j + 1
        if done.any():
            out[live[done]] = score[done]
        # the lower edge never falls, and the last row regains at most 2 tau
        keep = ~done & (score <= 3 * tau)
        if not keep.all():
            live, pattern, text, m, n, vp, vn, score = (a[keep] for a in (live, pattern, text, m, n, vp, vn, score))
            if not len(live):
                break
    return np.minimum(out, tau + 1)


def close_pairs(texts: list[np.ndarray], a: np.ndarray, b: np.ndarray, tau: int, step: int = 1 << 14) -> np.ndarray:
    """Which pairs of texts (indexes a and b) are within tau edits."""
    size = np.array([len(t) for t in texts])
    bags = np.zeros((len(texts), 64), np.int16)
    for i, t in enumerate(texts):
        bags[i] = np.bincount(t & 63, minlength=64)
    out = np.zeros(len(a), dtype=bool)
    for s in range(0, len(a), 1 << 17):
        i, j = a[s : s + (1 << 17)], b[s : s + (1 << 17)]
        near = np.abs(size[i] - size[j]) <= tau
        near[near] = np.abs(bags[i[near]] - bags[j[near]]).sum(axis=1) <= 2 * tau
        out[s : s + (1 << 17)] = near
    pick = np.flatnonzero(out)
    pick = pick[np.argsort(size[a[pick]], kind="stable")]
    at = 0
    while at < len(pick):  # about 16 MB of code points at a time
        hi = min(len(pick), at + max(1, min(step, (1 << 21) // (int(size[a[pick[at]]]) + tau + 1))))
        some = pick[at:hi]
        at = hi
        m, n = size[a[some]], size[b[some]]
        left, right = np.full((len(some), m.max() + 1), 0xFFFFFFFF, np.uint32), np.full((len(some), n.max() + 1), 0xFFFFFFFE, np.uint32)
        for k, q in enumerate(some):
            left[k, : m[k]] = texts[a[q]]
            right[k, : n[k]] = texts[b[q]]
        out[some] = edit_distances(left, right, m, n, tau) <= tau
    return out


#: Keys that a task holds before it hands them on.
HELD = 1 << 19


def _keys(p: LineParams, buckets: int):
    """(bucket, run): the keys of the different lines, in runs of one bucket: all keys, then all line hashes, then all entered flags."""

    def run(batches):
        settle()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen, n = np.zeros(0, np.int64), 0

        def out():
            key, h, entered = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, h, entered, bucket = key[order], h[order], entered[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            runs = [key[a:b].tobytes() + h[a:b].tobytes() + entered[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(runs, pa.binary())], ["bucket", "run"])

        for batch in batches:
            for _lo, _hi, data, off in blocks(text_of(batch)):
                x = Lines(data, off, p)
                h, own = np.unique(x.hash, return_index=True)
                own = own[~np.isin(h, seen)]
                if not len(own):
                    continue
                h = x.hash[own]
                seen = np.union1d(seen, h)
                held.append(keys_of(Points(data), x.start[own], x.end[own], h, p))
                n += len(held[-1][0])
                if n >= HELD:
                    yield out()
                    held, seen, n = [], np.zeros(0, np.int64), 0
        if n:
            yield out()

    return run


def _meet(p: LineParams):
    """The members of the keys with an entered line and another, and their blocks; a partition has whole buckets."""

    def run(batches):
        settle()
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                n = len(raw) // 17
                parts.append((np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, bool, n, 16 * n)))
        if not parts:
            return
        key, h, entered = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(key)
        s = key[order]
        same = np.append(False, s[1:] == s[:-1])
        same[:-1] |= same[1:]
        order = order[same]
        key, h, entered = key[order], h[order], entered[order]
        order = np.lexsort((~entered, h, key))
        key, h, entered = key[order], h[order], entered[order]
        new = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])) if len(key) else np.zeros(0, bool)
        key, h, entered = key[new], h[new], entered[new]
        if not len(key):
            return
        _, first, size = np.unique(key, return_index=True, return_counts=True)
        full = np.repeat((size > 1) & (np.add.reduceat(entered.astype(np.int64), first) > 0), size)
        last = np.repeat((size - 1) // p.block, size)
        block = (np.arange(len(key)) - np.repeat(first, size)) // p.block
        cols = [x[full] for x in (key, h, entered, block, last)]
        for a in range(0, len(cols[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in cols], ["key", "h", "entered", "block", "last"])

    return run


def _texts(p: LineParams, rows: Bloom, hashes: Bloom):
    """(h, line_text) of the lines whose row and hash are in the maps."""

    def run(batches):
        settle()
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                own = batch.slice(part, 4096)
                own = own.filter(pa.array(rows.has(own.column(0).to_numpy())))
                for _lo, _hi, data, off in blocks(text_of(own)):
                    x = Lines(data, off, p)
                    h, first = np.unique(x.hash, return_index=True)
                    first = first[hashes.has(h)]
                    yield pa.RecordBatch.from_arrays([pa.array(x.hash[first]), pa.array([x.raw[i].decode() for i in first], pa.string())], ["h", "line_text"])

    return run


NO_ID = FAR = (1 << 63) - 1


def _first_met(raw: list[str], size: np.ndarray, key: np.ndarray, i: np.ndarray, j: np.ndarray, p: LineParams) -> np.ndarray:
    """Which pairs (the entered text i, the probing text j) are met under the key at hand first: the key of i's first segment that j
    has within its window. So a pair that shares several segments counts once."""
    at = np.concatenate([[0], np.cumsum(size)])
    points = Points(np.frombuffer("".join(raw).encode(), np.uint8))
    length, less = size[i], size[j] - size[i]
    out, open_ = np.zeros(len(i), bool), np.ones(len(i), bool)
    for s in range(p.tau + 1):
        a, n = segment(length, s, p.tau + 1)
        mine = points.spans(at[i] + a, at[i] + a + n)
        low = np.maximum(np.maximum(a - s, a + less - (p.tau - s)), 0)
        high = np.minimum(np.minimum(a + s, a + less + (p.tau - s)), size[j] - n)
        has = np.zeros(len(i), bool)
        for step in range(2 * p.tau + 1):
            ok = low + step <= high
            b = at[j][ok] + low[ok] + step
            has[ok] |= points.spans(b, b + n[ok]) == mine[ok]
        salt = mix((length * (p.tau + 1) + s).astype(np.uint64) + np.uint64(0xABCD))
        out |= open_ & has & (mix(mine + salt).view(np.int64) == key[i])
        open_ &= ~has
    return out


def _verify(p: LineParams):
    """(h, source, links, root) of the lines with another within tau edits: the doc_id of the earliest found, if it is earlier, the copies
    of the others, and a line of its component. Each pair counts under one key and in one pair of blocks."""

    def run(batches):
        settle()
        for t in groups(batches, 3):
            key, bi, bj, h, entered, block, doc, row, line = (t.column(i).to_numpy(zero_copy_only=False) for i in range(9))
            copies = t.column(9).to_numpy()
            raw = t.column(10).to_pylist()
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])))
            out: list[tuple[np.ndarray, ...]] = []
            ends = np.append(cuts[1:], len(key))
            at = 0
            while at < len(cuts):  # small groups are verified together
                a, b = [], []
                first = at
                pairs = 0
                while at < len(cuts) and (at == first or pairs < 1 << 16):
                    lo, hi = cuts[at], ends[at]
                    left = np.arange(lo, hi)[entered[lo:hi].astype(bool)]
                    for i in left:  # the entered line is the shorter one, or as long
                        mine = np.arange(lo, hi)
                        if bi[lo] == bj[lo]:
                            mine = mine[mine != i]
                        else:
                            mine = mine[block[lo:hi] != block[i]]
                        a.append(np.full(len(mine), i))
                        b.append(mine)
                        pairs += len(mine)
                    at += 1
                if not pairs:
                    continue
                lo, hi = cuts[first], ends[at - 1]
                texts = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in raw[lo:hi]]
                i, j = np.concatenate(a), np.concatenate(b)
                size = np.array([len(x) for x in texts])
                fit = (size[i - lo] < size[j - lo]) | ((size[i - lo] == size[j - lo]) & (h[i] < h[j]))
                i, j = i[fit], j[fit]
                ok = close_pairs(texts, i - lo, j - lo, p.tau)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                ok = _first_met(raw[lo:hi], size, key[lo:hi], i - lo, j - lo, p)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                early = (doc[i] < doc[j]) | ((doc[i] == doc[j]) & ((row[i] < row[j]) | ((row[i] == row[j]) & (line[i] < line[j]))))
                late, source = np.where(early, j, i), np.where(early, i, j)
                first_doc = np.full(hi - lo, FAR)
                np.minimum.at(first_doc, late - lo, doc[source])
                links = np.zeros(hi - lo, np.int64)
                np.add.at(links, i - lo, copies[j])
                np.add.at(links, j - lo, copies[i])
                # a line is in several groups here: its place is its hash
                names, at_name = np.unique(h[lo:hi], return_inverse=True)
                root = names[local_components(at_name[i - lo], at_name[j - lo], len(names))][at_name]
                own = np.flatnonzero(links)
                out.append((h[lo:hi][own], first_doc[own], links[own], root[own], np.isin(own, late - lo)))
            x = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
            source = pa.array(x[1], pa.int64(), mask=~x[4])
            yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), source, pa.array(x[2], pa.int64()), pa.array(x[3], pa.int64())], ["h", "source", "links", "root"])

    return run


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(h, doc_id, row, line) of every line with a solid character; doc_id is NO_ID for rows without one."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), row_hash(docs).alias("row"), F.posexplode(_split(docs["text"])).alias("line", "s"))
    return rows.select("doc_id", "row", "line", _stripped(F.col("s")).alias("s")).filter("s <> ''").select(F.xxhash64("s").alias("h"), "doc_id", "row", F.col("line").cast("long").alias("line"))


def verdicts(docs: DataFrame, seen: DataFrame, p: LineParams) -> DataFrame:
    """(h, d, r, l, n, source, links, root) of every line that has a copy or a near one: d, r and l are its first place, n its copies,
    source, links and root as _verify has them (null, 0 and h without a near one)."""
    deal = tasks(docs, 32 << 20)
    keys = docs.select("text").mapInArrow(_keys(p, 8 * deal), "bucket int, run binary")
    met = stored(keys.repartition(deal, "bucket").mapInArrow(_meet(p), "key long, h long, entered boolean, block long, last long"), "met")
    wanted = stored(met.select("h").distinct(), "wanted")
    places = seen.groupBy("h").agg(F.min(F.struct("doc_id", "row", "line")).alias("at"), F.count(F.lit(1)).alias("n"))
    places = places.join(wanted.withColumn("near", F.lit(True)), "h", "left").filter("n > 1 or near")
    places = stored(places.select("h", F.col("at.doc_id").alias("d"), F.col("at.row").alias("r"), F.col("at.line").alias("l"), "n", "near"), "places")
    near, count = places.filter("near").select("h", "d", "r", "l", "n"), wanted.count()
    maps = Bloom(near.select("r").distinct(), count), Bloom(wanted, count)
    texts = docs.select(row_hash(docs).alias("row"), "text").mapInArrow(_texts(p, *maps), "h long, line_text string")
    texts = stored(texts.join(near, "h").dropDuplicates(["h"]), "texts")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
    pairs = met.select("key", "h", "entered", "block", other).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    members = pairs.join(texts, "h").select("key", "bi", "bj", "h", "entered", "block", "d", "r", "l", "n", "line_text")
    dealt = members.repartition(deal, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "h")
    found = stored(dealt.mapInArrow(_verify(p), "h long, source long, links long, root long"), "near")
    roots = components(found.select(F.col("h").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "h")
    found = found.groupBy("h").agg(F.min("source").alias("source"), F.sum("links").alias("links")).join(roots, "h")
    out = places.join(found, "h", "left").filter("n > 1 or links is not null")
    return out.select("h", "d", "r", "l", "n", "source", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "h").alias("root"))


def linked_rows(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """(row, doc_id, lines) of every row with a line that has a copy or a near one: for each of those lines its number, whether it goes, whether as a near
    copy, the smallest doc_id that has what it copies, the other lines linked to it, and the component of its text. A stored table."""
    seen = stored(occurrences(docs), "lines")
    verdict = stored(verdicts(docs, seen, p), "verdicts")
    linked = join_unique(seen, verdict, "h", "n")
    goes = F.col("source").isNotNull() | (F.col("doc_id") != F.col("d")) | (F.col("row") != F.col("r")) | (F.col("line") != F.col("l"))
    source = F.least(F.coalesce("source", "d"), F.col("d"))
    item = F.struct("line", goes.alias("goes"), F.col("source").isNotNull().alias("near"), source.alias("source"), (F.col("n") - 1 + F.col("links")).alias("links"), "root")
    return stored(linked.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.collect_set(item).alias("lines")), "linked")


def dropped_lines(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """(doc_id, row, line, near, source) of every line that goes; doc_id is NO_ID for documents without one."""
    return linked_rows(docs, p).select("doc_id", "row", F.inline("lines")).filter("goes").select("doc_id", "row", "line", "near", "source")


def classes(linked: DataFrame) -> DataFrame:
    """(row, class_id, n_links) of the rows with a line that has a copy or a near one. A class is all documents that such lines join, in
    however many steps; class_id is its smallest doc_id, null if none has one. n_links is the sum over the row's lines of
    the other lines of the table that equal them or are within tau edits."""
    links = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["links"])
    roots = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["root"])))
    rows = stored(linked.select("row", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), links.alias("n_links"), roots.alias("roots")), "rows")
    # a row joins all its lines' components to the first of them, so rows need no node of their own
    first = F.get("roots", F.lit(0)).alias("first")
    edges = rows.filter(F.size("roots") > 1).select(first, F.explode("roots").alias("b")).filter("first <> b")
    comp = components(edges.select(F.col("first").alias("a"), "b")).select(F.col("node").alias("first"), F.col("root").alias("comp"))
    per = rows.groupBy(first).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).join(comp, "first", "left")
    per = stored(per.select("first", "least", "rows", F.coalesce("comp", "first").alias("comp")), "firsts")
    named = per.groupBy("comp").agg(F.min("least").alias("class_id"))
    per = stored(per.join(named, "comp").select("first", "class_id", "rows"), "named")
    return join_unique(rows.select("row", "n_links", first), per, "first", "rows").select("row", "class_id", "n_links")


def _unused(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has."""
    taken = {c.lower() for c in columns}
    while taken & {n.lower() for n in names}:
        names = tuple(f"_{n}" for n in names)
    return list(names)


def dedup_lines(docs: DataFrame, p: LineParams = LineParams(), linked: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """docs with all its columns, the lines that go taken out of text, and four more columns, whose names are returned:
    lines, lines gone as exact and as near copies, and the smallest doc_id that has one of the lines that went (null where none went).
    linked: linked_rows of docs, if it is known.
    """
    m_row, gone, n_lines, exact, near, source = _unused(docs.columns, "_m_row", "_gone", "_lines", "_exact", "_near", "_source")
    out = (linked_rows(docs, p) if linked is None else linked).select(F.col("row").alias(m_row), F.filter("lines", lambda x: x["goes"]).alias(gone)).filter(F.size(gone) > 0).hint("merge")  # a table that grows with the input
    joined = docs.join(out, row_hash(docs) == out[m_row], "left")

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(gone, lambda x: x["line"].cast("int")))
        text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
        lost = F.coalesce(F.size(F.filter(gone, lambda x: x["near"])), F.lit(0))
        lost = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(lost)
        all_ = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone))
        solid = F.size(F.filter(lines, lambda x: _stripped(x) != ""))
        low = F.array_min(F.transform(gone, lambda x: x["source"]))
        return F.struct(text.alias("text"), *(c.cast("long").alias(n) for c, n in ((solid, n_lines), (all_ - lost, exact), (lost, near), (low, source))))

    # the generator keeps filters on its columns from computing them anew
    made = joined.select(*(docs[c] for c in docs.columns if c != "text"), F.inline(F.transform(F.array(_split(docs["text"])), rest)))
    return made.select(*docs.columns, n_lines, exact, near, source), [n_lines, exact, near, source]


def strip_duplicates(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """docs without the lines that go, and without documents that thereby lose their last line with a solid character; n_chars, if there is such a column, follows the text."""
    out, (lines_n, exact, near, _) = dedup_lines(docs, p)
    lost = F.col(exact) + F.col(near)
    out = out.filter((lost == 0) | (lost < F.col(lines_n)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def line_classes(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """One row for each row of docs: doc_id, class_id and n_links as classes() has them (its own doc_id and 0 without links), n_lines,
    n_near (lines gone as near copies), and the length and CRC of the text that is left."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    linked = linked_rows(docs, p)
    out, (lines, _, near, _) = dedup_lines(docs.withColumn("row", row_hash(docs)), p, linked)
    text = F.coalesce("text", F.lit(""))
    left = out.select("doc_id", "row", F.col(lines).alias("n_lines"), F.col(near).alias("n_near"), F.length(text).cast("long").alias("kept_chars"), F.crc32(text.cast("binary")).alias("kept_crc32"))
    class_id = F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    return left.join(classes(linked), "row", "left").select("doc_id", class_id, "n_lines", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_near", "kept_chars", "kept_crc32")
