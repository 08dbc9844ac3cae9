"""Every query that has SQL gives the rows of its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quillon.plans import oracle, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        found.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return found


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query(spark, con, name):
    got, want = queries.queries()[name](spark, str(DATA)).toPandas(), con.sql(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["kmeans_full", "kmeans_log"])
def test_rows_only(spark, name):
    assert queries.queries()[name](spark, str(DATA)).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert {*oracle.SQL} <= {*__spark_entry__.queries()}
