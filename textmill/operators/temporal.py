"""As-of joins and sessions over timed rows of skewed keys, in two levels: within each key's bucket of time, and over what the buckets hand on.

No window holds all rows of a key: the large ones are of a key and bucket, and those of a whole key have a few rows for each of its buckets. Times are
TIMESTAMP or TIMESTAMP_NTZ; rows with a null key or time meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def micros(time: Column) -> Column:
    """Microseconds since 1970 by the clock that the time shows."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def bucket(at: Column, seconds: int) -> Column:
    return F.floor(at / (seconds * 1_000_000)).cast("long")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], tie: str, width: int = DAY) -> DataFrame:
    """left with the values of the last row of right with the same key at or before its time, null where there is none.

    Of right rows of one key and time the one with the greatest tie counts. Each bucket of width seconds starts with the last row of the buckets before it, which
    a window over the buckets' last rows carries on; both sides are then in one window for each key and bucket. Every row of left stays, repeats included.
    """
    own, found = [F.col(c) for c in left.columns], F.struct(*(F.col(c).alias(c) for c in values))
    shape = f"struct<{','.join(f'`{c}`:{right.schema[c].dataType.simpleString()}' for c in values)}>"
    of_tie = right.schema[tie].dataType.simpleString()
    rows = left.select(F.col(key).alias("_k"), micros(F.col(left_time)).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(of_tie).alias("_tie"), F.struct(*own).alias("_row"), F.lit(None).cast(shape).alias("_found"))
    known = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    none = F.lit(None).cast(left.select(F.struct(*own)).schema[0].dataType)
    given = right.select(F.col(key).alias("_k"), micros(F.col(right_time)).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), none.alias("_row"), found.alias("_found")).filter(known)
    at = bucket(F.col("_t"), width).alias("_b")
    inside = rows.filter(known).unionByName(given).withColumn("_b", at)

    last = given.groupBy("_k", at).agg(F.max_by("_found", F.struct("_t", "_tie")).alias("_found"))
    asked = rows.filter(known).select("_k", at).distinct().withColumn("_found", F.lit(None).cast(shape))
    ends = last.unionByName(asked).groupBy("_k", "_b").agg(F.first("_found", ignorenulls=True).alias("_found"))
    before = F.last("_found", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("_k", "_b", before.alias("_found")).filter("_found is not null")
    carried = carried.select("_k", F.lit(None).cast("long").alias("_t"), F.lit(-1).alias("_side"), F.lit(None).cast(of_tie).alias("_tie"), none.alias("_row"), "_found", "_b")

    order = Window.partitionBy("_k", "_b").orderBy(F.col("_t").asc_nulls_first(), "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    met = inside.unionByName(carried).withColumn("_found", F.last("_found", ignorenulls=True).over(order)).filter("_side = 1")
    out = met.select("_row", "_found").unionByName(rows.filter(~known).select("_row", "_found"))
    return out.select("_row.*", *(F.col(f"_found.{c}").alias(c) for c in values))


def sessions(events: DataFrame, key: str, time: str, gap: int, width: int = DAY) -> DataFrame:
    """(key, first, last, n): runs of a key's events in which each comes gap seconds after the one before at most, as in Spark's session windows.

    Each bucket of width seconds has its own runs. Only the first and the last of them can go on in another bucket; those are put together in a window of two rows
    for each bucket of a key.
    """
    rows = events.select(F.col(key).alias("_k"), F.col(time).alias("_time"), micros(F.col(time)).alias("_t")).filter("_k is not null and _t is not null")
    # equal times are one event with a weight, whatever their number
    rows = rows.groupBy("_k", "_t").agg(F.min("_time").alias("_time"), F.count(F.lit(1)).alias("_n")).withColumn("_b", bucket(F.col("_t"), width))

    def runs(df: DataFrame, within: list[str]) -> DataFrame:
        """df (_k, _t, _last, first, last, _n) by runs of rows that follow each other."""
        w = Window.partitionBy(*within).orderBy("_t")
        fresh = F.coalesce(F.col("_t") - F.lag("_last").over(w) > gap * 1_000_000, F.lit(True))
        marked = df.withColumn("_fresh", fresh.cast("long"))
        numbered = marked.withColumn("_run", F.sum("_fresh").over(w))
        return numbered.groupBy(*within, "_run").agg(F.min("_t").alias("_t"), F.max("_last").alias("_last"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("_n").alias("_n"))

    local = runs(rows.select("_k", "_b", "_t", F.col("_t").alias("_last"), F.col("_time").alias("first"), F.col("_time").alias("last"), "_n"), ["_k", "_b"])
    most = F.max("_run").over(Window.partitionBy("_k", "_b"))
    local = local.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == most)).drop("_run")
    done = ["_k", "first", "last", "_n"]
    whole = runs(local.filter("_edge").drop("_b", "_edge"), ["_k"]).select(*done)
    return local.filter("not _edge").select(*done).unionByName(whole).select(F.col("_k").alias(key), "first", "last", F.col("_n").alias("n"))
