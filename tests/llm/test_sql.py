"""Queries that SQL can express, against DuckDB on the smallest tables."""

import os

import pytest

from corpuslens.llm import queries
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], connect(FOLDER)) == []
