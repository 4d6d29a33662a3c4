"""The training-data queries that SQL can express, against DuckDB on all rows and columns."""

import os

import pytest
from compare import connect, differences

from tidemark.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_oracle(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None
