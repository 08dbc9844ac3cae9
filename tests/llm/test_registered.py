"""Registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from quillon.llm import queries
from quillon.llm.secrets import redacted, scan

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    got, want = queries.queries()[name](spark, str(DATA)).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline(spark):
    """Every stage against what its own operator says of its input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        kept = out.toPandas()
        assert out.columns == columns and 0.7 * before <= len(kept) <= before, name
        if name == "secrets":
            want = {r["doc_id"]: redacted(r["text"], scan(r["text"]), corpus_pipeline.MARK) for r in docs.collect()}
            assert dict(zip(kept["doc_id"], kept["text"], strict=True)) == want
        before = len(kept)
        docs = spark.createDataFrame(kept, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).toPandas()
    assert packed["doc_id"].nunique() == before
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096


def test_near_duplicates_with_repeated_ids(spark):
    """Rows of one id: a near copy goes alone, of equal rows one stays, rows without an id or a word all stay."""
    text = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, text("a")), (5, text("a") + " end"), (5, text("b")), (6, text("c")), (6, text("c")), (7, text("c")), (8, text("d")), (8, text("d").upper()), (9, text("e")), (10, text("b")), (3, text("f")), (3, text("g")), (2, text("g"))]
    rows += [(None, text("a")), (None, text("a")), (11, ""), (11, ""), (11, None), (11, None)]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id bigint, text string, n_chars int").repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    got = sorted((str(r["doc_id"]), (r["text"] or "")[:2].lower()) for r in out.collect())
    assert out.columns == docs.columns
    assert got == sorted([("1", "a0"), ("5", "b0"), ("6", "c0"), ("8", "d0"), ("9", "e0"), ("3", "f0"), ("2", "g0"), ("None", "a0"), ("None", "a0"), *[("11", "")] * 4])
