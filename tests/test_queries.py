"""Every query with SQL against that SQL, in DuckDB, on the smallest tables."""


import duckdb
import pytest

import __spark_entry__ as entry
from folioflow.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


QUERIES, QUERY_SQL = entry.queries() | plans.FIXED, entry.oracle_sql() | plans.FIXED_SQL


@pytest.mark.parametrize("name", sorted(QUERY_SQL))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF), db.sql(QUERY_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
