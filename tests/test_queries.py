"""Registered queries against their SQL at the smallest scale; the llm queries are added where that folder exists."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows

NAMES = sorted(set(entry.queries()) & set(entry.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, duck, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
