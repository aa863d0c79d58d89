import pytest
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import quality

GOOD = "The committee met on Tuesday to review the plans for the new library, and several members raised questions about parking, lighting and the cost of the roof. " * 3


def fails(spark, *rows, cfg=quality.QualityConfig(), schema="text string"):
    docs = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).withColumn("doc_id", F.monotonically_increasing_id())
    return [r.fails for r in quality.check_documents(docs, cfg).orderBy("doc_id").collect()]


def test_rules_fire(spark):
    bullets = "\n".join(f"- item number {i} of the long list" for i in range(60))
    ellipses = "\n".join(f"this line number {i} trails off into nothing..." for i in range(20))
    paragraphs = "\n\n".join(["one paragraph that is said again and again here"] * 10)
    got = fails(spark, GOOD, "Just a few words here.", "#buy #cheap #now #deal #sale " * 30, bullets, ellipses, "the same sentence stands here once more\n" * 40, " ".join(map(str, range(200))), paragraphs, "")
    assert got[0] == []
    assert "too_short" in got[1]
    assert "symbol_ratio" in got[2]
    assert "mostly_bullets" in got[3]
    assert "ellipsis_lines" in got[4]
    assert "dup_lines" in got[5]
    assert "low_alpha_words" in got[6]
    assert "dup_paragraphs" in got[7]
    assert got[8] == ["too_short", "symbol_ratio", "mostly_bullets", "ellipsis_lines", "dup_lines"]


def test_too_long_and_null_text(spark):
    assert fails(spark, GOOD, cfg=quality.QualityConfig(max_words=10)) == [["too_long"]]
    assert fails(spark, (None,)) is not None


@pytest.mark.parametrize("score,language,expected", [(3.5, 0.95, []), (2.1, 0.95, ["low_score"]), (3.5, 0.4, ["low_language_score"]), (None, None, [])])
def test_scores_are_lenient_where_missing(spark, score, language, expected):
    got = fails(spark, (GOOD, score, language), cfg=quality.QualityConfig(min_score=3.0), schema="text string, score double, language_score double")
    assert got == [expected]


def test_python_white_space(spark):
    odd = "a b\x1cc　d e\x85f"
    row = spark.createDataFrame([(odd, "x\r\ny\x0bz w", "   x\x1f ")], "a string, b string, c string").select(T.words(F.col("a")).alias("w"), T.lines(F.col("b")).alias("l"), T.strip(F.col("c")).alias("s")).first()
    assert row.w == odd.split()
    assert row.l == ["x", "y", "z", "w"]
    assert row.s == "x"


def test_reports(spark):
    docs = spark.createDataFrame([(0, GOOD), (1, "short"), (2, "short too"), (3, "# # #")], "doc_id long, text string")
    checked = quality.check_documents(docs)
    assert {r.reason: r.n_docs for r in quality.reason_histogram(checked).collect()}["too_short"] == 3
    top = quality.combination_top(checked).collect()
    assert top[0].n_docs == 2
    rate = quality.keep_rate(checked).first()
    assert (rate.docs_seen, rate.docs_kept) == (4, 1)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_filter(docs).count() == 0
    assert quality.keep_rate(quality.check_documents(docs)).first().doc_rate == 0


def test_texts_are_split_once_in_every_plan(spark):
    """Filters and reports on the rules' failures compute no figure again."""
    from textmill.plans import catalogue

    for name in ("quality_filter", "quality_reason_histogram", "quality_combo_top8", "quality_keep_rate", "quality_fails", "word_stats"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") <= 1 and plan.count("split(text") <= 2, name
