"""Benchmark decontamination in DataFrame operations only.

A document is contaminated by an item if some window of it, of as many words as the item, has a weighted-shingle similarity
(sum of the smaller over sum of the larger multiplicities of five-word shingles) of at least 0.8 to the item.

1. Two bags of shingles reach similarity t only if they share t / (1 + t) of the shingles of both. So windows are laid at every start from
   which a window as long as an item holds that many places whose shingle some item of that length has, in whatever order; nothing above the
   threshold is lost.
2. Each different window content gets a 64-bit SimHash of its shingles, and so does each item.
3. Multi-index Hamming blocks: the 64 bits are five blocks. Two fingerprints within radius 19 differ by at most three bits in some
   block, so every item is entered under all values of each block within three flips, and an equi-join on (length, block, value)
   finds all pairs of one length within the radius; the Hamming distance then sifts them. A window is only ever compared with items of its own length, so
   the pairs that meet are a quarter of those of one length, not of all.
4. The exact similarity of the window and the item verifies each pair.

At similarity 0.8 two fingerprints differ in 9.7 of 64 bits on average with a standard deviation of 2.9, so a pair at the threshold is beyond the
radius about three times in ten thousand, and copies never are.

Words are runs outside ``[\\x20\\x09-\\x0D]``, lower-cased. Defined results: a null text is an empty one and is clean; items and documents of fewer than five words
have no shingle and never match; a document shorter than an item is one window; repeated rows get equal results, also where
they repeat a doc_id with another text, and null ids are ids; items with a null id or text are left out, and items that repeat an id count as
one id; empty tables give clean documents or an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BitMap, row_hash, stored, without

K = 5
SIMILARITY = 0.8
RADIUS = 19
#: (first bit, bits) of the blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
FLIPS = RADIUS // len(BLOCKS)
#: Rows up to which a side is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    """The hashes of the words of a text, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _rolled(h: Column) -> Column:
    """The hashes of the five-word shingles, in order; empty where there are fewer than five words."""
    return F.when(F.size(h) >= K, F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(K))))).otherwise(F.array().cast("array<bigint>"))


def _once(value: Column, name: str) -> Column:
    """A column of its own out of a generator, which the optimizer doesn't compute again wherever it is named."""
    return F.inline(F.array(F.struct(value.alias(name))))


def simhash(s: Column) -> Column:
    """Bit b is set if more of the shingles (with multiplicity) have it set than not."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("bigint"),
        lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.when(F.aggregate(s, F.lit(0), lambda a, x: a + F.when(F.call_function("getbit", x, b) == 1, 1).otherwise(-1)) > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"), b)),
    )


def _block_values(fp: Column) -> Column:
    """An array of (block, value) of a fingerprint."""
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).alias("value")) for i, (first, bits) in enumerate(BLOCKS)))


def _flips(bits: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(FLIPS + 1) for c in combinations(range(bits), n)]


def _starts(hits: Column, n: Column, size: Column, similarity: float) -> Column:
    """The starts of the windows (size shingles, or all n of a shorter document) that hold enough of the ascending places of shingles
    that an item of this size has: a similarity of t takes t / (1 + t) of the shingles of both sides. The window of hit i to hit
    i + need - 1 has a range of starts; the ranges ascend, so each goes on where the one before ends."""
    own = F.least(size, n)
    need = F.greatest(F.lit(1), F.ceil((size + own) * (similarity / (1 + similarity)) - 1e-9).cast("int"))

    def at(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.get(hits, i + need - 1) - own + 1)
        high = F.least(F.get(hits, i), n - own)
        before = F.when(i > 0, F.least(F.get(hits, i - 1), n - own)).otherwise(F.lit(-1))
        low = F.greatest(low, before + 1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(hits) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits) - need), at))).otherwise(F.array().cast("array<int>"))


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """df is a stored table, so counting it is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _weighted(contents: DataFrame, key: str) -> DataFrame:
    """(key, bag): the shingles of s with their running number among equals, so that sets of them are multisets."""
    rows = contents.select(key, F.posexplode("s").alias("at", "x"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, "x").orderBy("at")))
    return numbered.groupBy(key).agg(F.collect_list(F.xxhash64("x", "n")).alias("bag"))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row, item_id, similarity): the best window of each row (by its hash) for each item that it has."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("h"))
    items = stored(items.select("item_id", F.size("h").alias("width"), _rolled(F.col("h")).alias("s")).filter(F.size("s") > 0).distinct().withColumn("item", F.xxhash64("item_id", "s")), "items")
    places = stored(items.select("width", F.explode("s").alias("x")).distinct(), "places")

    hashed = docs.select(row_hash(docs).alias("row"), _once(word_hashes(F.col("text")), "h")).select("row", _once(_rolled(F.col("h")), "s"))
    # the size is a column before the rows are exploded, so that no row carries the array
    laid = hashed.select("row", F.size("s").alias("n"), "s").select("row", "n", F.posexplode("s").alias("at", "x"))
    hits = laid.join(_maybe_broadcast(places), "x").groupBy("row", "width", "n").agg(F.sort_array(F.collect_set("at")).alias("hits"))
    windows = hits.select("row", F.explode(_starts(F.col("hits"), F.col("n"), F.col("width") - K + 1, similarity)).alias("start"), "width")
    windows = windows.groupBy("row").agg(F.collect_list(F.struct("start", "width")).alias("windows"))

    here = stored(windows, "windows")  # a table that grows with the input: its map, of bounded size, picks the texts that are joined with it
    map_ = BitMap(here.select("row"), here.count())
    joined = docs.filter(map_.has(row_hash(docs))).select(row_hash(docs).alias("row"), "text").join(here.hint("merge"), "row")
    cut = joined.select("row", "windows", _once(word_hashes(F.col("text")), "h")).select("row", "windows", _once(_rolled(F.col("h")), "all"))
    cut = cut.select("row", "all", F.inline("windows")).select("row", "width", F.slice("all", F.col("start") + 1, F.col("width") - K + 1).alias("s")).distinct()
    cut = stored(cut.withColumn("content", F.xxhash64("s", "width")), "cut")
    contents = cut.select("content", "width", "s").dropDuplicates(["content"])

    found = contents.withColumn("fp", simhash(F.col("s")))
    prints = stored(found.select("content", "width", "fp"), "prints")
    probe = prints.select("content", "width", "fp", F.inline(_block_values(F.col("fp"))))
    entry = items.select("item", "width", simhash(F.col("s")).alias("item_fp")).dropDuplicates(["item"]).select("item", "width", "item_fp", F.inline(_block_values(F.col("item_fp"))))
    flips = F.when(F.col("block") < len(BLOCKS) - 1, F.array(*map(F.lit, _flips(13)))).otherwise(F.array(*map(F.lit, _flips(12))))
    entry = entry.select("item", "width", "item_fp", "block", F.explode(flips).alias("flip"), "value")
    entry = entry.select("item", "width", "item_fp", "block", F.col("value").bitwiseXOR(F.col("flip").cast("bigint")).alias("value")).hint("merge")
    near = probe.join(entry, ["width", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("content", "item").distinct()

    bags = _weighted(contents.select("content", "s").join(near, "content", "left_semi"), "content")
    item_bags = _weighted(items.select("item", "s").dropDuplicates(["item"]), "item").withColumnRenamed("bag", "item_bag")
    both = F.size(F.array_intersect("bag", "item_bag"))
    sure = near.join(bags, "content").join(item_bags, "item").select("content", "item", (both / (F.size("bag") + F.size("item_bag") - both)).alias("similarity")).filter(F.col("similarity") >= similarity)
    sure = sure.join(items.select("item", "item_id"), "item").select("content", "item_id", "similarity")
    return cut.select("row", "content").join(sure, "content").groupBy("row", "item_id").agg(F.max("similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, contaminated, items (ascending ids), similarity (the best, 0 if clean). Null ids are ids, a null text is clean;
    an empty table gives an empty result."""
    per = matches(docs, benchmark, similarity).groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.round(F.max("similarity"), 9).alias("similarity"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row")).join(per, "row", "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without an item, with all their columns."""
    return without(docs, stored(matches(docs, benchmark, similarity).select(F.col("row").alias("_m_row")).distinct(), "bad"))
