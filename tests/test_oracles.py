"""Every registered query against its DuckDB counterpart, all rows and columns."""

from __future__ import annotations

import os

import pytest
from compare import connect, differences

from tidemark.testdata.oracles import ORACLES
from tidemark.testdata.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, db, name):
    assert differences(QUERIES[name](spark, SF_DIR), db, ORACLES[name]) is None
