"""Every text query that has SQL against DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from latticework.llm import registry  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


def same(df, want):
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    assert got == sorted(map(repr, want.select(*cols).fetchall())) and got


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, con, name):
    same(registry.QUERIES[name](spark, DIR), con.sql(registry.ORACLE_SQL[name]))


def test_pipeline(spark, con):
    import corpus_pipeline

    same(corpus_pipeline.run(spark, DIR), con.sql(corpus_pipeline.ORACLE_SQL))
