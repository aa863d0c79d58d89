"""Distinct counts and quantiles by several dimensions from sketches that are stored once and merged upward.

A stored row holds the count, a HyperLogLog sketch of the distinct items and a KLL sketch of the values of one combination of all dimensions. Rows of new data are
added beside the old ones; every coarser view, and the cube of all, merges rows and reads no data again. Sketches have a bounded size, so a hot combination costs
one row for each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of the distinct sketch (its relative standard error is 1.04 / sqrt(2**LG)), and the size of the quantile sketch (rank error about 1.3 %).
LG, K = 12, 200


def sketched(rows: DataFrame, dimensions: list[str], item: Column, value: Column) -> DataFrame:
    """(dimensions, n, items, spread): one row for each combination of dimensions that there is, null being a value. Null items and values count into n only."""
    return rows.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(item, LG).alias("items"), F.kll_sketch_agg_bigint(value.cast("long"), K).alias("spread"))


def _merged(groups) -> DataFrame:
    return groups.agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_bigint("spread").alias("spread"))


def rolled_up(sketches: DataFrame, dimensions: list[str]) -> DataFrame:
    """The same by some of the dimensions, or by none: one row."""
    return _merged(sketches.groupBy(*dimensions))


def cube(sketches: DataFrame, dimensions: list[str]) -> DataFrame:
    """The same for every subset of the dimensions, with level: bit i from the right is set where the i-th dimension from the right is summed over, which tells that from
    a null value."""
    out = sketches.cube(*dimensions).agg(F.grouping_id().alias("level"), F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_bigint("spread").alias("spread"))
    return out.select(*dimensions, "level", "n", "items", "spread")


def distinct(items: Column | str) -> Column:
    return F.hll_sketch_estimate(items)


def quantile(spread: Column | str, rank: float) -> Column:
    """The value at a rank from 0 to 1; 0 and 1 are the exact least and greatest."""
    return F.kll_sketch_get_quantile_bigint(spread, F.lit(rank))
