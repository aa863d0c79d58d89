import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.operators import language, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs)


def test_trigrams_equal_brute_force(monkeypatch):
    monkeypatch.setattr(language, "PIECE", 10)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abÉ日 ") for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))) for _ in range(60)] + [None, "", "ab"]
    want = []
    for i, t in enumerate(texts):
        d = (t or "").lower().encode()
        want += [(i, ((d[k] << 16 | d[k + 1] << 8 | d[k + 2]) * 2654435761 % (1 << 32)) >> 16) for k in range(len(d) - 2)]
    got = [(int(r), int(b)) for rows, bs in language._trigrams(pa.array(texts)) for r, b in zip(rows, bs, strict=True)]
    assert got == want


def test_held_out_accuracy(docs, model):
    rows = {r.lang: (r.n, r.right) for r in language.held_out_accuracy(language.scored(docs, model)).collect()}
    n, right = map(sum, zip(*rows.values(), strict=True))
    assert len(rows) == 4 and n > 150 and right >= 0.98 * n


def test_scores_are_calibrated(docs, model):
    """Over rows that no fit has seen, the mean probability of the likeliest language is how often it is right."""
    rows = language.scored(docs.withColumn("claimed", F.col("lang")).withColumn("lang", F.lit(None).cast("string")), model).filter(language.held_out("doc_id"))
    p, right = rows.agg(F.avg("language_score"), F.avg((F.col("language") == F.col("claimed")).cast("double"))).first()
    assert abs(p - right) < 0.05


def test_the_language_rule_uses_the_score(spark, docs, model):
    """A text that claims another language falls below the rule's floor; its own does not."""
    long_ = docs.filter("length(text) > 600").limit(200)
    wrong = long_.withColumn("lang", F.element_at(F.create_map(*(F.lit(x) for p in zip(model.languages, [*model.languages[1:], model.languages[0]], strict=True) for x in p)), F.col("lang")))
    share = lambda df: quality.check_documents(language.scored(df, model)).agg(F.avg(F.array_contains("fails", "low_language_score").cast("double"))).first()[0]
    assert share(wrong) > 0.95 and share(long_) < 0.05


def test_odd_rows(spark, model):
    rows = [(1, None, "en"), (2, "", "en"), (3, "ab", "en"), (4, "the words of this text", "xx"), (None, "the words " * 300_000, None), (4, "the words of this text", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("fits", F.lit("mine"))
    got = sorted(((r.doc_id, r.language, r.language_score) for r in language.scored(df, model).collect()), key=repr)
    assert [g[1:] for g in got if g[0] in (1, 2, 3)] == [(None, None)] * 3
    assert [g[2] for g in got if g[0] == 4] == [0.0, 0.0] and [g[2] for g in got if g[0] is None][0] > 0.3
    assert language.scored(df.limit(0), model).count() == 0
    none = language.train(df.limit(0))
    assert none.languages == [] and np.isfinite(none.temperature)
