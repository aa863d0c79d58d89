import math
import random
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import sketches

DIMS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    hot = [("x", "p", 1, rng.randrange(4000), rng.randrange(10**6)) for _ in range(15_000)]  # a third of all rows
    rest = [(rng.choice(["x", "y", None]), rng.choice("pqrs"), rng.randrange(3), rng.choice([None, rng.randrange(9000)]), rng.choice([None, int(rng.paretovariate(0.7) * 100)])) for _ in range(30_000)]
    return hot + rest


@pytest.fixture(scope="module")
def stored_parts(spark, rows):
    """Two parts sketched apart, as new data would be."""
    df = spark.createDataFrame(rows, "a string, b string, c int, item long, value long")
    parts = [sketches.sketched(df.filter(F.expr(p)), DIMS, F.col("item"), F.col("value")) for p in ("item % 2 = 0", "item % 2 = 1 or item is null")]
    return parts[0].unionByName(parts[1]).cache()


def exact(rows):
    out = defaultdict(list)
    for r in rows:
        for keep in product((0, 1), repeat=3):
            out[(*(v if k else None for v, k in zip(r[:3], keep)), sum((1 - k) << (2 - i) for i, k in enumerate(keep)))].append(r)
    return out


def test_cube_counts_are_exact_and_sketches_within_their_bounds(rows, stored_parts):
    want = exact(rows)
    got = {(r.a, r.b, r.c, r.level): r for r in sketches.cube(stored_parts, DIMS).select("*", sketches.distinct("items").alias("d"), *(sketches.quantile("spread", q).alias(f"q{i}") for i, q in enumerate((0.0, 0.5, 0.9, 1.0)))).collect()}
    assert got.keys() == want.keys()
    for key, own in want.items():
        r, values = got[key], sorted(x[4] for x in own if x[4] is not None)
        assert r.n == len(own) and (r.q0, r.q3) == (values[0], values[-1])
        items = len({x[3] for x in own if x[3] is not None})
        assert abs(r.d - items) <= max(1, 4 * 1.04 / math.sqrt(1 << sketches.LG) * items)
        for q, x in ((0.5, r.q1), (0.9, r.q2)):
            low, high = np.searchsorted(values, x, "left") / len(values), np.searchsorted(values, x, "right") / len(values)
            assert low - 0.03 <= q <= high + 0.03


def test_rolling_up_twice_is_rolling_up_once(stored_parts):
    show = lambda df, *by: sorted((tuple(r) for r in df.select(*by, "n", sketches.distinct("items")).collect()), key=repr)
    twice = sketches.rolled_up(sketches.rolled_up(stored_parts, ["a", "b"]), ["b"])
    assert show(twice, "b") == show(sketches.rolled_up(stored_parts, ["b"]), "b")
    assert show(sketches.rolled_up(twice, [])) == show(sketches.rolled_up(stored_parts, []))


def test_no_rows_and_only_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None, None)] * 3, "a string, b string, c int, item long, value long")
    one = sketches.cube(sketches.sketched(df, DIMS, F.col("item"), F.col("value")), DIMS).select("n", sketches.distinct("items").alias("d")).collect()
    assert len(one) == 8 and all(r.n == 3 and r.d == 0 for r in one)
    assert sketches.sketched(df.limit(0), DIMS, F.col("item"), F.col("value")).count() == 0
