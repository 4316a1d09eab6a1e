"""Every query that has a statement in SQL, against DuckDB over the same files."""

import os

import duckdb
import pytest

from residua.plans import corpus_queries, file_queries, model_queries, pair_queries

SF = "/root/testdata/sf0.001"
PLANS = (corpus_queries, pair_queries, model_queries, file_queries)
QUERIES = {name: f for plan in PLANS for name, f in plan.QUERIES.items()}
SQL = {name: sql for plan in PLANS for name, sql in plan.SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(df):
    """Sorted rows; whole numbers that stand in a column with nulls come as floats from one engine."""
    df = df[sorted(df.columns)].astype(object)
    plain = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(repr(tuple(map(plain, r))) for r in df.where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
