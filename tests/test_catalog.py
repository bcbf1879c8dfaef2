"""Every query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest
from conftest import SF

from tidemark import catalog

WITHOUT_SQL = sorted(set(catalog.queries()) - set(catalog.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted(repr(tuple(r[c] for c in order)) for r in got) == sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_bounds_reach_the_scan(spark):
    plan = catalog.queries()["range_incl_excl"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_id,20)" in plan and "LessThan(user_id,60)" in plan
    assert "props" not in plan
