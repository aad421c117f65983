"""Every registered query against its SQL on the generic test tables."""

import os

import pytest

import __spark_entry__ as registry
from compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The text operators have their own tests.
ORACLES = {name: sql for name, sql in registry.oracle_sql().items() if name not in registry._llm_sql()}
QUERIES = registry._report_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == []


def test_entry(spark):
    assert registry.entry(spark).count() > 0
