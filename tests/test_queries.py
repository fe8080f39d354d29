"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as entry_points
import pytest
from compare import database, difference
from conftest import SMALL

from topicspark.checks.catalog import QUERIES
from topicspark.checks.oracles import ORACLES


@pytest.fixture(scope="module")
def db():
    return database(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, db, name):
    assert difference(spark, db, SMALL, QUERIES[name], ORACLES[name]) is None


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry_points.queries().keys() and ORACLES.keys() <= entry_points.oracle_sql().keys()
