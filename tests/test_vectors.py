import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import vectors
from textmill.operators.storage import stored


def recall(spark, found, exact):
    """The share of the exact answers' places that a neighbour at most as far fills."""
    far = exact.groupBy("query").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("k"))
    hits = found.join(far, "query").groupBy("query").agg(F.count_if(F.col("distance") <= F.col("far") + 1e-9).alias("hits"))
    r = far.join(hits, "query", "left").agg(F.sum("k"), F.sum(F.least(F.coalesce("hits", F.lit(0)), "k"))).first()
    return r[1] / r[0]


def test_recall_on_the_given_table(spark):
    """Every row indexed, queries with an id divisible by 100, against all rows."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = table.filter("vec_id % 100 = 0")
    book = vectors.fit(table, "vec_id", "embedding")
    codes = stored(vectors.index(table, "vec_id", "embedding", book), "codes")
    assert codes.count() == table.count()
    found = stored(vectors.search(table, queries, "vec_id", "embedding", book, codes), "found")
    exact = stored(vectors.exact_search(table, queries, "vec_id", "embedding"), "exact")
    assert found.count() == exact.count() == 10 * queries.count()
    assert recall(spark, found, exact) >= 0.9


def test_all_probes_and_a_long_shortlist_are_exact(spark, monkeypatch):
    """With small blocks, a vector that a third of the rows have, ties, and rows that cannot be compared."""
    monkeypatch.setattr(vectors, "BLOCK", 50)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 6)).round(2)
    x[:100] = x[0]
    rows = [(i, [float(v) for v in w]) for i, w in enumerate(x)]
    odd = [(900, None), (901, [1.0]), (902, [float("nan")] * 6), (903, [None] * 6), (904, []), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("id", "v", "list", "query", "rank")})
    queries = df.filter("vec_id % 20 = 0 or vec_id >= 900")
    book = vectors.fit(df, "vec_id", "embedding", lists=5)
    codes = stored(vectors.index(df, "vec_id", "embedding", book), "codes")
    assert codes.count() == 300
    got = {}
    for q in sorted(vectors.search(df, queries, "vec_id", "embedding", book, codes, 7, 5, 300).collect(), key=lambda q: (q["query"], q["rank"])):
        got.setdefault(q["query"], []).append(q["id"])
    f = x.astype(np.float32).astype(np.float64)
    want = {i: np.lexsort((np.arange(300), ((f - f[i]) ** 2).sum(axis=1)))[:7].tolist() for i in range(0, 300, 20)}
    assert got == want


@pytest.mark.parametrize("n", [0, 1])
def test_no_vectors(spark, n):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>").limit(n)
    book = vectors.fit(df, "vec_id", "embedding")
    assert (book is None) == (n == 0)
    if book:
        codes = vectors.index(df, "vec_id", "embedding", book)
        assert [tuple(r) for r in vectors.search(df, df, "vec_id", "embedding", book, codes).collect()] == [(1, 1, 1, 0.0)]
        assert vectors.search(df, df.limit(0), "vec_id", "embedding", book, codes).count() == 0
