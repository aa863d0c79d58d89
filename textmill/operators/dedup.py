"""Near-duplicate removal: shingles, MinHash, banded LSH, confirmed star edges, components, winners.

The signature is a vectorised Arrow map (unsigned 64-bit wrap-around is a loss in ANSI SQL); all else is DataFrame plans. Buckets
are never collected: each member is joined to its bucket's smallest document, so candidates grow with the members.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_line
from . import arrow
from .storage import join_unique, stored

# The mixer's constants.
MIX_ADD, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
EMPTY = 0xFFFFFFFFFFFFFFFF


def splitmix64(z: np.ndarray) -> np.ndarray:
    """The mixer on uint64, modulo 2**64."""
    z = z + np.uint64(MIX_ADD)
    for shift, factor in ((30, MIX_1), (27, MIX_2)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def permutation_offsets(num_perm: int = 128, seed: int = 1) -> np.ndarray:
    """One uint64 for each permutation, from NumPy's seeded generator."""
    return np.random.default_rng(seed).integers(0, 1 << 64, size=num_perm, dtype=np.uint64)


def signature_of(items: list[str], offsets: np.ndarray) -> np.ndarray:
    """For each permutation, the smallest mixed hash of the shingles; all ones where there is none."""
    if not items:
        return np.full(len(offsets), EMPTY, np.uint64)
    return _lowest(np.array([zlib.crc32(s.encode()) for s in items], np.uint64), offsets)


def _lowest(base: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each permutation, the smallest mixed hash; base has one at least."""
    low = np.full(len(offsets), EMPTY, np.uint64)
    for at in range(0, len(base), 512):  # memory stays bounded for long texts
        z = base[None, at : at + 512] + (offsets + np.uint64(MIX_ADD))[:, None]
        t = np.empty_like(z)
        for shift, factor in ((30, MIX_1), (27, MIX_2), (31, None)):  # splitmix64() in place
            np.right_shift(z, np.uint64(shift), out=t)
            np.bitwise_xor(z, t, out=z)
            if factor:
                np.multiply(z, np.uint64(factor), out=z)
        np.minimum(low, z.min(axis=1), out=low)
    return low


def shingle_bounds(line: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """Where the k-word shingles of a line of words (its bytes) begin and end; all words are one if there are fewer, none of an empty line."""
    if not len(line):
        return [], []
    gap = np.flatnonzero(line == 32)
    if len(gap) < k - 1:
        return [0], [len(line)]
    start, end = np.append(0, gap + 1), np.append(gap, len(line))
    return start[: len(start) - k + 1].tolist(), end[k - 1 :].tolist()


def line_signature(line: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """signature_of() the shingles of a line of words, which are hashed where they lie."""
    start, end = shingle_bounds(line, k)
    if not start:
        return np.full(len(offsets), EMPTY, np.uint64)
    raw = memoryview(line.tobytes())
    crc = np.fromiter((zlib.crc32(raw[i:j]) for i, j in zip(start, end, strict=True)), np.uint32, len(start))
    return _lowest(np.unique(crc).astype(np.uint64), offsets)


def signatures(docs: DataFrame, num_perm: int = 128, seed: int = 1, k: int = 5) -> DataFrame:
    """(doc_idx, chars, signature): signature holds the bit patterns of uint64 in an array of longs."""
    offsets = permutation_offsets(num_perm, seed)

    def run(batches):
        for batch in arrow.parts(batches, 2, 1 << 20):
            data, row = arrow.text_bytes(batch.column(2))
            sig = np.stack([line_signature(data[i:j], offsets, k) for i, j in zip(row, row[1:])])  # noqa: B905
            flat = pa.array(sig.reshape(-1).view(np.int64))
            at = pa.array(np.arange(0, sig.size + 1, num_perm, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, flat)], ["doc_idx", "chars", "signature"])

    rows = docs.select("doc_idx", F.length("text").cast("long").alias("chars"), word_line(F.coalesce("text", F.lit(""))).alias("line"))
    return rows.mapInArrow(run, "doc_idx long, chars long, signature array<long>")


def signature_jvm(items: Column, num_perm: int = 128, seed: int = 1) -> Column:
    """The same signature as an expression, for sessions without ANSI overflow checks; sign bits are flipped for the minimum."""
    offsets = F.array(*(F.lit(int(x)) for x in permutation_offsets(num_perm, seed).view(np.int64)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    sign = F.lit(-(1 << 63))

    def mixed(z: Column) -> Column:
        z = z + F.lit(signed(MIX_ADD))
        for shift, factor in ((30, MIX_1), (27, MIX_2)):
            z = z.bitwiseXOR(F.shiftrightunsigned(z, shift)) * F.lit(signed(factor))
        return z.bitwiseXOR(F.shiftrightunsigned(z, 31))

    base = F.transform(items, lambda s: F.crc32(F.encode(s, "utf-8")))
    least = F.transform(offsets, lambda o: F.array_min(F.transform(base, lambda x: mixed(x + o).bitwiseXOR(sign))).bitwiseXOR(sign))
    return F.when(F.size(items) == 0, F.array_repeat(F.lit(-1).cast("long"), num_perm)).otherwise(least)


def estimated_jaccard(a: Column, b: Column) -> Column:
    """The share of equal slots."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def true_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def implied_threshold(num_perm: int, bands: int) -> float:
    """The similarity at which a pair is as likely to share a band as not, about."""
    if num_perm % bands:
        raise ValueError("bands must divide the permutations")
    return (1 / bands) ** (bands / num_perm)


def band_keys(sigs: DataFrame, bands: int = 16, num_perm: int = 128) -> DataFrame:
    """(band, key, doc_idx): each band's slots, hashed to 128 bits for the shuffle."""
    if num_perm % bands:
        raise ValueError("bands must divide the permutations")
    rows = num_perm // bands
    part = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.slice("signature", b * rows + 1, rows))).alias("band", "slots")
    return sigs.select("doc_idx", part).select("band", F.struct(F.xxhash64("slots").alias("a"), F.xxhash64(F.lit(1), "slots").alias("b")).alias("key"), "doc_idx")


def buckets(keys: DataFrame) -> DataFrame:
    """(band, key, anchor, members) of the buckets with two members or more."""
    return keys.groupBy("band", "key").agg(F.min("doc_idx").alias("anchor"), F.count(F.lit(1)).alias("members")).filter("members > 1")


def candidate_edges(keys: DataFrame) -> DataFrame:
    """(src, dst): each bucket's anchor with each other member, once."""
    flat = keys.select("band", F.col("key.a").alias("a"), F.col("key.b").alias("b"), "doc_idx")
    found = buckets(keys).select("band", F.col("key.a").alias("a"), F.col("key.b").alias("b"), "anchor", "members")
    flat = stored(flat, "band_keys")
    return join_unique(flat, stored(found, "buckets"), ["band", "a", "b"], "members").filter("doc_idx <> anchor").select(F.col("anchor").alias("src"), F.col("doc_idx").alias("dst")).distinct()


def edge_jaccard(edges: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """(src, dst, jaccard): the true similarity of the shingles of the two texts of each edge. Lines of words are joined to the edges, and an edge's
    sets of shingles are made where they are compared: as a table they would be k times the text."""

    def run(batches):
        for wide in arrow.parts(batches, 2, 1 << 20):
            for batch in arrow.parts([wide], 3, 1 << 20):
                out = []
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = ({raw[i:j] for i, j in zip(*shingle_bounds(np.frombuffer(raw, np.uint8), k), strict=True)} for raw in (a.encode(), b.encode()))
                    both = len(x & y)
                    out.append(both / max(len(x) + len(y) - both, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["src", "dst", "jaccard"])

    lines = docs.select("doc_idx", word_line(F.coalesce("text", F.lit(""))).alias("line"))
    ends = edges.select(F.col("src").alias("doc_idx")).unionAll(edges.select("dst")).distinct()
    lines = stored(lines.join(ends, "doc_idx", "left_semi"), "lines")
    both = edges.join(lines.select(F.col("doc_idx").alias("src"), F.col("line").alias("a")), "src").join(lines.select(F.col("doc_idx").alias("dst"), F.col("line").alias("b")), "dst")
    return both.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long, jaccard double")


def confirmed_edges(edges: DataFrame, sigs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The edges whose estimate reaches the threshold. Signatures of anchors with many edges are joined by broadcast."""
    edges = stored(edges, "candidates")
    one = sigs.select(F.col("doc_idx").alias("src"), F.col("signature").alias("_a"))
    two = sigs.select(F.col("doc_idx").alias("dst"), F.col("signature").alias("_b"))
    one = stored(one.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("_n")), "src"), "anchors")
    both = join_unique(edges, one, "src", "_n").join(two, "dst").withColumn("estimate", estimated_jaccard(F.col("_a"), F.col("_b")))
    return both.filter(F.col("estimate") >= threshold).select("src", "dst", "estimate")


def connected_components(edges: DataFrame) -> DataFrame:
    """(doc_idx, component): the smallest document of each component, for documents with an edge.

    Each round maps every node to that of itself and its neighbours whose hash is the smallest, and contracts the graph to what they are mapped to. Hashes have no order
    that a chain of documents could follow, so a round leaves a constant share of the nodes at most in expectation, and stars vanish at once. Every round is a
    stored table; a node with very many edges is aggregated before the shuffle and joined apart.
    """
    pairs = lambda df, u, v: df.filter(F.col(u) != F.col(v)).select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct()
    hashed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    left, maps = stored(pairs(edges, "src", "dst"), "edges"), []
    while n := left.count():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(left.select("b", "a"))
        near = both.groupBy("node").agg(F.min(hashed("to")).alias("to"), F.count(F.lit(1)).alias("_n"))
        low = stored(near.select("node", F.least("to", hashed("node"))["id"].alias("root"), "_n"), "roots")
        maps.append(low.select("node", "root"))
        to = lambda key, root: low.select(F.col("node").alias(key), F.col("root").alias(root), "_n")  # noqa: B023, E731
        half = stored(join_unique(left, to("a", "ra"), "a", "_n", n).select("ra", "b"), "half")
        left = stored(pairs(join_unique(half, to("b", "rb"), "b", "_n", n), "ra", "rb"), "edges")
    if not maps:
        return left.select(F.col("a").alias("doc_idx"), F.col("b").alias("component"))
    out = maps[0]
    for low in maps[1:]:  # roots that are gone with their edges have no further one
        further = low.select(F.col("node").alias("root"), F.col("root").alias("further"))
        out = out.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    out = stored(out, "roots")
    first = out.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("_n"))
    return join_unique(out, stored(first, "components"), "root", "_n").select(F.col("node").alias("doc_idx"), "component")


def clusters(sigs: DataFrame, bands: int = 16, num_perm: int = 128, threshold: float = 0.8) -> DataFrame:
    """(doc_idx, component) of every document; singletons are their own component. sigs: a stored table."""
    found = stored(confirmed_edges(candidate_edges(band_keys(sigs, bands, num_perm)), sigs, threshold).select("src", "dst"), "confirmed")
    return sigs.select("doc_idx").join(connected_components(found), "doc_idx", "left").select("doc_idx", F.coalesce("component", "doc_idx").alias("component"))


def winners(members: DataFrame, cluster: str = "component", weight: str = "chars", order: str = "doc_idx") -> DataFrame:
    """(cluster, winner, members): the heaviest member, ties to the smallest. One aggregation with map-side combine."""
    best = F.max(F.struct(F.col(weight).alias("w"), (-F.col(order)).alias("o")))
    return members.groupBy(cluster).agg(best.alias("_best"), F.count(F.lit(1)).alias("members")).select(cluster, (-F.col("_best.o")).alias("winner"), "members")


def dedup(docs: DataFrame, num_perm: int = 128, bands: int = 16, threshold: float = 0.8, seed: int = 1, weight: Column | None = None) -> DataFrame:
    """The rows of docs (with doc_idx and text) that win their cluster."""
    sigs = stored(signatures(docs, num_perm, seed), "signatures")
    near = stored(clusters(sigs, bands, num_perm, threshold), "clusters")
    weights = docs.select("doc_idx", weight.alias("chars")) if weight is not None else sigs.select("doc_idx", "chars")
    best = stored(winners(near.join(weights, "doc_idx")), "winners")
    losers = join_unique(near, best, "component", "members").filter("doc_idx <> winner").select("doc_idx")
    return docs.join(losers, "doc_idx", "left_anti")


def dedup_stats(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Documents and characters before and after."""
    total = docs.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))
    after = kept.agg(F.count(F.lit(1)).alias("kept_docs"), F.sum(F.length("text")).alias("kept_chars"))
    share = lambda a, b: F.round(100 * (F.col(b) - F.col(a)) / F.greatest(F.col(b), F.lit(1)), 4)
    return total.join(after).withColumns({"removed_docs_pct": share("kept_docs", "docs"), "removed_chars_pct": share("kept_chars", "chars")})


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The first row of each different text, null texts being equal; a null id comes last. Rows that repeat text and id all stay if they are first.

    Ids and digests alone are shuffled to find the rows that go; they are known by both.
    """
    own = {"_d": F.coalesce(F.md5("text"), F.lit("")), "_i": F.coalesce(F.col("doc_idx").cast("long"), F.lit(0).cast("long")), "_n": F.col("doc_idx").isNull()}
    keyed = docs.select("doc_idx", *(c.alias(k) for k, c in own.items()))
    first = keyed.groupBy("_d").agg(F.min("doc_idx").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    again = join_unique(keyed, stored(first, "copies"), "_d", "n", docs.count()).filter("not doc_idx <=> first").select(*own)
    return docs.withColumns(own).join(again.distinct(), list(own), "left_anti").drop(*own)
