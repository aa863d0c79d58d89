import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textmill.operators import temporal
from textmill.streaming import streams

ZERO = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else ZERO + timedelta(seconds=seconds)


def brute_asof(left, right):
    out = []
    for i, k, t in left:
        known = [(u, tie, v) for kk, u, tie, v in right if k is not None and t is not None and kk == k and u is not None and u <= t]
        out.append((i, max(known, key=lambda r: (r[0], r[1]))[2] if known else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("width", [1, 600, 10**9])
def test_asof_equals_brute_force(spark, kind, width):
    rng = random.Random(width)
    some = lambda n: rng.choice([None, *range(n)])
    left = [(i, some(4), rng.choice([None, *range(0, 9000, 50)])) for i in range(300)] + [(999, 1, 50)] * 3
    right = [(some(4), rng.choice([None, *range(0, 9000, 25)]), i, rng.choice([None, i])) for i in range(120)]
    a = spark.createDataFrame([(i, k, at(t), "mine") for i, k, t in left], "i long, k long, t timestamp, _found string").withColumn("t", F.col("t").cast(kind))
    b = spark.createDataFrame([(k, at(t), tie, v) for k, t, tie, v in right], "k long, u timestamp, tie long, v long").withColumn("u", F.col("u").cast(kind))
    got = temporal.asof_join(a, b, "k", "t", "u", ["v"], "tie", width)
    assert got.columns == ["i", "k", "t", "_found", "v"]
    assert sorted(((r.i, r.v) for r in got.collect()), key=repr) == brute_asof(left, right)
    assert temporal.asof_join(a.limit(0), b, "k", "t", "u", ["v"], "tie").count() == 0
    assert temporal.asof_join(a, b.limit(0), "k", "t", "u", ["v"], "tie").filter("v is not null").count() == 0


def brute_sessions(rows, gap):
    out = []
    for k in {k for k, t in rows if k is not None}:
        run = []
        for t in sorted(t for kk, t in rows if kk == k and t is not None):
            if run and t - run[-1] > gap:
                out.append((k, at(run[0]), at(run[-1]), len(run)))
                run = []
            run.append(t)
        if run:
            out.append((k, at(run[0]), at(run[-1]), len(run)))
    return sorted(out)


@pytest.mark.parametrize("width", [7, 100, 86_400])
def test_sessions_equal_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice([None, 0, 1, 2]), rng.choice([None, rng.randrange(4000)])) for _ in range(400)] + [(3, i * 10) for i in range(300)] + [(4, 5)] * 4
    df = spark.createDataFrame([(k, at(t)) for k, t in rows], "k long, t timestamp")
    got = sorted(tuple(r) for r in temporal.sessions(df, "k", "t", 10, width).collect())
    assert got == brute_sessions(rows, 10)


def test_a_hot_key_is_split_by_time(spark):
    """No window over a whole key has more than two rows for each of its buckets."""
    df = spark.range(20_000).selectExpr("1L AS k", "timestamp_seconds(id * 100) AS t")
    assert temporal.sessions(df, "k", "t", 50, 1000).count() == 20_000
    assert temporal.sessions(df, "k", "t", 100, 1000).collect()[0].n == 20_000


@pytest.mark.parametrize("seed", [0, 1])
def test_session_stream_equals_the_batch_in_any_order_of_arrival(spark, tmp_path, seed):
    """Rows arrive up to the delay after their time, in instalments that are shuffled within; later ones are set apart."""
    rng, gap, delay = random.Random(seed), 30, 200
    rows = [(rng.randrange(3), t, t + rng.choice([0, 1, 60, delay, delay + 1, 900])) for t in (rng.randrange(6000) for _ in range(300))] + [(None, 5, 6), (1, None, 7), (1, 8, None)]
    rows.append((9, 50_000, 50_000))  # closes all others
    src, out, late, state = (str(tmp_path / x) for x in ("in", "out", "late", "state"))
    schema = "k long, t timestamp, arrived timestamp"
    arrivals = sorted(rows, key=lambda r: r[2] or 0)
    for part in (arrivals[:100], arrivals[100:200], arrivals[200:]):
        rng.shuffle(part)
        spark.createDataFrame([(k, at(t), at(a)) for k, t, a in part], schema).coalesce(1).write.mode("append").parquet(src)
        for q in streams.session_stream(spark.readStream.schema(schema).parquet(src), "k", "t", "arrived", gap, delay, out, late, state):
            q.awaitTermination(120)
    known = lambda r: None not in r and r[2] - r[1] <= delay
    want = [s for s in brute_sessions([r[:2] for r in rows if known(r)], gap) if s[0] != 9]
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("k", "first", "last", "n").collect()) == want
    assert spark.read.schema(schema).parquet(late).count() == sum(not known(r) for r in rows) > 3
