"""Every query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=repr)
