"""Queries of the library against their SQL in DuckDB, over whole tables at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from graphset.queries import oracle_sql, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer documents embeddings events lineitem nation orders part".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(x):
    return (None if x != x else round(float(x), 5)) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got, want = queries()[name](spark, DATA).toPandas(), db.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted((tuple(map(plain, r)) for r in got[cols].values.tolist()), key=str) == sorted((tuple(map(plain, r)) for r in want[cols].values.tolist()), key=str)


def test_entry_names_are_complete():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(queries()) >= 70
