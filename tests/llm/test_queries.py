"""The queries of these operators against their SQL, where there is some."""

from __future__ import annotations

import pytest
from compare import database, difference

from topicspark.llm.oracles import ORACLES
from topicspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(spark, database(FOLDER), FOLDER, QUERIES[name], ORACLES[name]) is None


def test_there_are_thirteen():
    assert [int(n.split("_")[0][2:]) for n in QUERIES] == list(range(1, 14))
