import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from textmill.llm import queries

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_table(spark, name):
    table, key = {"op9": ("pages", "page_id"), "op12": ("conversations", "conv_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    given = spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct()
    got = queries.QUERIES[name](spark, SF).select(key).distinct()
    if name.startswith("op11"):  # the documents that changes concern and that are ever present
        assert got.join(given.select((F.col(key) - F.pmod(key, F.lit(5))).alias(key)).distinct(), key).count() == got.count() > given.count() / 10
    else:
        assert got.count() == given.count()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.simpleString() == docs.schema.simpleString()
            assert 0 < out.count() <= now.count()
            now = out
    assert [r.doc_id for r in out.select("doc_id").distinct().orderBy("doc_id").collect()] == [r.doc_id for r in now.select("doc_id").orderBy("doc_id").collect()]
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def test_stages_on_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(0, None, None, None, None), (None, "", "en", "s", 0), (1, "x " * 50_000, None, "s", 100_000), (2, "short", "en", None, 5), (2, "short", "en", None, 5)]
    for docs in (spark.createDataFrame(rows, schema).withColumn("line", F.lit(1)), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
