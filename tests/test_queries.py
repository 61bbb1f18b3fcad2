"""Every registered query against its SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from arcwindow.plans.catalog import QUERIES
from arcwindow.plans.oracle import ORACLES
from tests.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


def test_every_query_has_sql():
    """Queries that other folders add bring their own tests where SQL cannot express them."""
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query(spark, tables, name):
    got = contract.queries()[name](spark, SF_DIR).toPandas()
    want = tables.execute(contract.oracle_sql()[name]).df()
    assert len(got) > 0
    assert differences(got, want) == ""


def test_entry(spark):
    assert contract.entry(spark).columns == ["space", "pivot", "context", "occurrences"]
