"""Ordered corpora: caps and budgets, prefix positions, splits, token streams and the windows cut from them.

Spark rows have no order, so every operator takes an explicit order column. Running totals are two-level: totals of ranges
of the order column are summed on a small table, then each range counts on by itself; no window runs over the whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored

RANGE = 4096
#: 2**53 steps make a uniform double.
_UNIT = float(1 << 53)


def prefix_sum(df: DataFrame, value: Column, order: str, name: str, width: int = RANGE) -> DataFrame:
    """df with name: the sum of value over the rows before, by order (a dense integer, such as a document index).

    A null value counts as 0. Rows with a null order stand nowhere: they are left out, and count into no sum. The totals of ranges of width indexes are summed over a table a width-th as long, itself in two levels.
    """
    rows = df.filter(F.col(order).isNotNull()).withColumn("_v", F.coalesce(value.cast("long"), F.lit(0).cast("long"))).withColumn("_r", F.floor(F.col(order) / width).cast("long"))
    sums = rows.groupBy("_r").agg(F.sum("_v").alias("_s")).withColumn("_q", F.floor(F.col("_r") / width).cast("long"))
    tops = sums.groupBy("_q").agg(F.sum("_s").alias("_t"))
    top = tops.select("_q", F.coalesce(F.sum("_t").over(Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    base = sums.join(F.broadcast(top), "_q").select("_r", (F.col("_b") + F.coalesce(F.sum("_s").over(Window.partitionBy("_q").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_base"))
    own = F.coalesce(F.sum("_v").over(Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(base, "_r").withColumn(name, F.col("_base") + own).drop("_v", "_r", "_base")


def budget_cut(df: DataFrame, size: Column, order: str, budget: int) -> DataFrame:
    """The first rows whose sizes reach the budget; the row that crosses it is the last."""
    return prefix_sum(df, size, order, "_before").filter(F.col("_before") < budget).drop("_before")


def json_line_bytes(*columns: str) -> Column:
    """Bytes of a row as a line of JSON with its line feed."""
    return F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})) + 1


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """The rows whose order is below n: the same ones every time, unlike limit()."""
    return df.filter(F.col(order) < n)


def hash_split(key: Column, fraction: float, names: tuple[str, str] = ("train", "val")) -> Column:
    """A coin for each key from its md5, the same in any engine."""
    draw = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return F.when(draw < int(fraction * (1 << 32)), F.lit(names[1])).otherwise(F.lit(names[0]))


def generator_split(df: DataFrame, order: str, fraction: float, seed: int = 0) -> DataFrame:
    """df with split: the coin that a sequential NumPy generator draws for each row in order, computed for each row by itself."""

    def run(batches):
        for batch in batches:
            draws = []
            for i in batch.column(batch.schema.get_field_index(order)).to_pylist():
                g = np.random.PCG64(seed)
                g.advance(i)
                draws.append((int(g.random_raw()) >> 11) / _UNIT)
            yield batch.append_column("split", pa.array(["val" if d < fraction else "train" for d in draws]))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("split", T.StringType())]))


def token_stream(docs: DataFrame, ids: Column, order: str, eot: int) -> DataFrame:
    """(order, ids, start_pos): each document's ids and an end id, and where they begin in the whole stream."""
    rows = docs.select(order, F.concat(ids, F.array(F.lit(eot))).alias("ids"))
    return prefix_sum(rows, F.size("ids"), order, "start_pos")


def split_counts(stream: DataFrame, split: str = "split") -> DataFrame:
    return stream.groupBy(split).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("ids")).alias("tokens"))


def _pieces(rows: DataFrame, first: Column, length: int, carry: list[str], *keep: str) -> DataFrame:
    """(keep, pos, ids, carry): of each row (start_pos, ids, carry), the part from position first on, length tokens at most."""
    at = F.greatest(F.lit(0).cast("long"), first - F.col("start_pos"))
    n = F.least(F.size("ids").cast("long"), first + length - F.col("start_pos")) - at
    cut = lambda c: F.slice(c, (at + 1).cast("int"), n.cast("int"))
    return rows.filter(n > 0).select(*keep, (F.col("start_pos") + at).alias("pos"), cut("ids").alias("ids"), *(cut(c).alias(c) for c in carry))


def _windows(pieces: DataFrame, length: int, carry: list[str], *key: str) -> DataFrame:
    """(key, x, y, carry) of the windows that are whole: length + 1 tokens, put together from their pieces."""
    whole = pieces.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "ids", *carry))).alias("_w"))
    flat = lambda c: F.flatten(F.transform("_w", lambda p: p[c]))
    rows = whole.select(*key, flat("ids").alias("_ids"), *(flat(c).alias(f"_{c}") for c in carry)).filter(F.size("_ids") == length + 1)
    return rows.select(*key, F.slice("_ids", 1, length).alias("x"), F.slice("_ids", 2, length).alias("y"), *(F.slice(f"_{c}", 2, length).alias(c) for c in carry))


def windows_at(stream: DataFrame, offsets: DataFrame, length: int, carry: list[str] | None = None, step: int = 1 << 13) -> DataFrame:
    """(window, x, y[, m]): length + 1 tokens from each offset of (window, offset), and the same shifted by one.

    A range join made an equi-join: offsets and documents ask for each block of step positions that they touch; a document
    gives a window the part that is in it, so no token has a row of its own. A window and a document that meet in two blocks
    count in the first. Whether a side is broadcast is left to the planner. A carried mask is aligned with y.
    """
    carry = carry or []
    last = lambda c: F.floor(c / step).cast("long")
    touched = lambda first, end: F.explode(F.sequence(last(first), last(end))).alias("block")
    asked = offsets.select("window", "offset", touched(F.col("offset"), F.col("offset") + length))
    end = F.col("start_pos") + F.size("ids") - 1
    have = stream.filter(F.size("ids") > 0).select("start_pos", "ids", *carry, touched(F.col("start_pos"), end))
    both = have.join(asked, "block").filter(F.col("block") == last(F.greatest("start_pos", "offset")))
    return _windows(_pieces(both, F.col("offset"), length + 1, carry, "window"), length, carry, "window")


def drawn(n: int, total: Column | int, seed: int = 0, index: Column | None = None) -> Column:
    """A draw with replacement below total for each index, from an md5: the same in any engine."""
    index = F.col("id") if index is None else index
    text = F.concat_ws(":", F.lit(seed), index)
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(total) if isinstance(total, int) else total)


def drawn_offsets(spark: SparkSession, n: int, total: int, length: int, seed: int = 0) -> DataFrame:
    """(window, offset): n uniform offsets in [0, total - length - 1), with replacement."""
    if total < length + 2:
        raise ValueError(f"a stream of {total} tokens has no window of {length}")
    return spark.range(n).select(F.col("id").alias("window"), drawn(n, total - length - 1, seed).alias("offset"))


def drawn_rows(rows: DataFrame, order: str, n: int, total: int, seed: int = 0) -> DataFrame:
    """rows with draw: n rows of the total, by their dense order, with replacement."""
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), drawn(n, total, seed).alias("_at"))
    return rows.join(draws, rows[order] == draws["_at"]).drop("_at")


def sweep(stream: DataFrame, total: int, batch: int, length: int, carry: list[str] | None = None) -> DataFrame:
    """(step, row, x, y): consecutive windows without overlap, whole batches only. A document gives each window that it touches its part,
    so there is no join and no table of offsets."""
    carry, step = carry or [], batch * length
    full = max(0, (total - 1) // step) * batch
    # window k has the positions from k * length to (k + 1) * length, the last of which it shares with its successor
    low = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("start_pos") / length).cast("long") - 1)
    high = F.least(F.floor((F.col("start_pos") + F.size("ids") - 1) / length).cast("long"), F.lit(full - 1).cast("long"))
    touched = F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))).alias("window")
    have = stream.filter(F.size("ids") > 0).select("start_pos", "ids", *carry, touched)
    rows = _windows(_pieces(have, F.col("window") * length, length + 1, carry, "window"), length, carry, "window")
    return rows.select(F.floor(F.col("window") / batch).cast("long").alias("step"), (F.col("window") % batch).alias("row"), "x", "y", *carry)


def shifted(ids: Column) -> tuple[Column, Column]:
    """All but the last, and all but the first."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, 1, n), F.slice(ids, 2, n)


def row_batches(rows: DataFrame, order: str, batch: int) -> DataFrame:
    """rows with step: full batches in order, the remainder dropped."""
    n = rows.count()
    return rows.withColumn("step", F.floor(F.col(order) / batch).cast("long")).filter(F.col("step") < n // batch)


def byte_shards(df: DataFrame, size: Column, order: str, limit: int) -> DataFrame:
    """df with shard: a row is in the shard of limit bytes in which it begins, so a shard is over the limit by less than its last row."""
    return prefix_sum(df, size, order, "_before").withColumn("shard", F.floor(F.col("_before") / limit).cast("long")).drop("_before")


def pack_corpus(docs: DataFrame, ids: Column, order: str, split: Column, eot: int) -> DataFrame:
    """(order, split, ids, start_pos): each document's ids and an end id, and where they begin in their split's stream.

    The splits' streams follow each other in the order of their names, and start_pos counts within each.
    """
    rows = docs.select(order, split.alias("split"), F.concat(ids, F.array(F.lit(eot))).alias("ids"))
    rows = stored(rows.withColumn("_n", F.size("ids")), "encoded")  # it is read for the names, the totals and the ids of each split
    names = sorted(r.split for r in rows.select("split").distinct().collect())
    out = None
    for name in names:
        one = prefix_sum(rows.filter(F.col("split") == name), F.col("_n"), order, "start_pos").drop("_n")
        out = one if out is None else out.unionByName(one)
    return rows.drop("_n").withColumn("start_pos", F.lit(0).cast("long")).limit(0) if out is None else out


def token_dtype(vocab: int) -> str:
    return "uint16" if vocab <= 1 << 16 else "uint32"


def pack_metadata(stream: DataFrame, chars: Column, eot: int, vocab: int) -> DataFrame:
    """One row: documents, tokens, characters for each token, and the type of the ids."""
    sums = stream.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("ids")).alias("tokens"), F.sum(chars).alias("chars"))
    return sums.select("docs", "tokens", F.round(F.col("chars") / F.greatest(F.col("tokens"), F.lit(1)), 3).alias("chars_per_token"), F.lit(eot).alias("eot_id"), F.lit(token_dtype(vocab)).alias("dtype"))
