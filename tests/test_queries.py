"""Every registered query against its SQL, on the given tables."""

import os

import pytest

from __spark_entry__ import entry
from casequarry.plans.catalog import ORACLES, QUERIES
from tests.check import compare, oracle_connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    outcome = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert outcome.startswith("ok") and "types differ" not in outcome, outcome


def test_entry(spark):
    assert entry(spark).count() > 0
