"""Every query with SQL against DuckDB, on the smallest tables."""

import pytest
from oracle_check import connect, differences

from meshflock.queries import EDG, ORACLES, PTS, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    """The Delaunay graph by SQL takes seconds: it is computed once and then read."""
    c = connect(D)
    c.execute(f"CREATE TABLE edges_once AS WITH {EDG} SELECT * FROM edg")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    sql = ORACLES[name].replace(EDG, f"{PTS}, edg AS (SELECT * FROM edges_once)")
    assert not differences(QUERIES[name](spark, D), sql, D, con)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0
