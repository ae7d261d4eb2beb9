"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import pytest

from __spark_entry__ import entry, oracle_sql
from courtside.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck_conn

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF_SMALL, QUERIES[name], ORACLES.get(name))
    assert r["status"] == "ok", r


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["conference", "seed", "team", "full_name", "wins", "losses",
                          "win_streak", "active_injuries", "last_n"]
    assert df.count() > 0
