import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from textmill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    show = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else repr(x)
    return sorted(tuple(show(r[i]) for i in at) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, db, name):
    df, sql = catalogue.QUERIES[name](spark, SF), db.sql(catalogue.ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns, order) == plain(sql.fetchall(), list(sql.columns), order)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
