"""Every registered query against its SQL twin, and the contract of the entry file."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

import __spark_entry__ as contract
from bandwright.plans.oracles import SQL

# Those of the training-data operators have a test of their own.
TWINS = SQL


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_matches_sql(spark, folder, con, name):
    assert compare(contract.queries()[name](spark, folder), con, TWINS[name]) is None


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:3] == ["score_name", "sample", "band"] and df.count() >= 30
