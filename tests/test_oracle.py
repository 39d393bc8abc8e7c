"""Every registered query against its DuckDB oracle (sf0.001), and the
rows-only queries for non-emptiness and stable schema."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quizlens.plans.fixtures import BASE_TABLES
from conftest import SF_SMALL

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


def _canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(_canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _canon(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_canon(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    drows = sorted((tuple(_canon(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert len(srows) == len(drows)
    assert srows == drows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    first = df.schema
    assert df.count() > 0
    assert QUERIES[name](spark, SF_SMALL).schema == first


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 200
    assert df.columns == ["mcq_id", "originality_corpus"]
