"""Every query with SQL against DuckDB on the smallest tables, and the driver's contract."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from rallyframe.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return repr(v.tolist())
        if v is None or v is pd.NA or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = db.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracle_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
