"""Every query with an SQL twin gives the same rows."""

import pytest
from harness import compare, oracle_connection

from riskframe.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle_connection(sf)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf, name):
    assert compare(QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()) == ""
