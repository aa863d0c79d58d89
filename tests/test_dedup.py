import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import dedup

WORDS = [f"w{i}" for i in range(400)]


def rows(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string")


def signature(spark, text):
    return np.array(dedup.signatures(rows(spark, text)).first().signature)


def test_shingles(spark):
    got = rows(spark, "a b c d e f", "short", "", "A b c d e a b c d e").select(T.shingles(F.col("text"))).collect()
    assert [len(r[0]) for r in got] == [2, 1, 0, 5]
    assert got[1][0] == ["short"]


def test_estimate_is_near_the_truth(spark):
    base = WORDS[:300]
    other = base[:]
    for i in range(0, 300, 50):
        other[i] = "changed"
    a, b = " ".join(base), " ".join(other)
    s = lambda t: {" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    true = len(s(a) & s(b)) / len(s(a) | s(b))
    assert abs((signature(spark, a) == signature(spark, b)).mean() - true) < 0.1
    far = " ".join(f"x{i}" for i in range(300))
    assert (signature(spark, a) == signature(spark, far)).mean() < 0.05


def test_jvm_form_is_the_same(spark):
    docs = rows(spark, "one two three four five six seven", "", "été à la plage", "just two")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        jvm = [r[0] for r in docs.orderBy("doc_idx").select(dedup.signature_jvm(T.shingles(F.col("text")), 16)).collect()]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert jvm == [r.signature for r in dedup.signatures(docs, 16).orderBy("doc_idx").collect()]


def test_weighted_winner_and_clusters(spark):
    base = " ".join(WORDS[:200])
    docs = rows(spark, base, base + " tail", base, " ".join(reversed(WORDS)))
    kept = sorted(r.doc_idx for r in dedup.dedup(docs, threshold=0.7).collect())
    assert kept == [1, 3]
    assert sorted(r.doc_idx for r in dedup.dedup(docs, threshold=0.7, weight=-F.col("doc_idx")).collect()) == [0, 3]


def test_empty_documents_are_copies_and_empty_table(spark):
    assert sorted(r.doc_idx for r in dedup.dedup(rows(spark, "", "", "a b c d e f g")).collect()) == [0, 2]
    assert dedup.dedup(spark.createDataFrame([], "doc_idx long, text string")).count() == 0


def test_components_of_long_chains(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "src long, dst long")
    got = {r.doc_idx: r.component for r in dedup.connected_components(edges).collect()}
    assert {got[i] for i in range(n)} == {0}
    assert got[1001] == 1000


def test_exact_dedup(spark):
    assert sorted(r.doc_idx for r in dedup.exact_dedup(rows(spark, "x", "y", "x", "x")).collect()) == [0, 1]


def test_bands_must_divide():
    with pytest.raises(ValueError):
        dedup.implied_threshold(128, 7)


def test_anchors_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("doc_id", "doc_idx")
    assert dedup.dedup(docs).count() == 186


def test_exact_dedup_of_nulls_and_repeats(spark):
    rows = [(5, "a"), (1, "b"), (5, "b"), (5, "b"), (2, None), (3, None), (None, None), (None, "b"), (None, "c"), (None, "c"), (7, "d"), (7, "d"), (8, "")]
    got = sorted(((r.doc_idx, r.text) for r in dedup.exact_dedup(spark.createDataFrame(rows, "doc_idx long, text string")).collect()), key=repr)
    assert got == sorted([(5, "a"), (1, "b"), (2, None), (None, "c"), (None, "c"), (7, "d"), (7, "d"), (8, "")], key=repr)


@pytest.mark.parametrize("shape", ["star", "chain", "random", "ring", "none", "repeats"])
def test_components_of_any_shape(spark, shape):
    rng = random.Random(1)
    edges = {
        "star": [(7, i) for i in range(100, 8100)], "chain": [(i, i + 1) for i in range(150)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(130)],
        "ring": [(i, (i + 1) % 40) for i in range(40)] + [(1000, 1001)], "none": [], "repeats": [(5, 6), (6, 5), (5, 5), (5, 6), (9, 9)],
    }[shape]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.doc_idx: r.component for r in dedup.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_signatures_of_lines_are_those_of_shingles():
    import numpy as np

    offsets = dedup.permutation_offsets()
    for words in ([], ["a"], list("abcd"), list("abcde"), ["é1", "b_", "c"] * 9, [str(i) for i in range(1500)]):
        items = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        line = np.frombuffer(" ".join(words).encode(), np.uint8)
        assert (dedup.line_signature(line, offsets, 5) == dedup.signature_of(items, offsets)).all()
        assert (dedup._lowest(np.array([7, 9], np.uint64), offsets) == dedup.splitmix64(np.array([[7, 9]], np.uint64) + offsets[:, None]).min(axis=1)).all()
