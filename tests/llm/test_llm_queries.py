"""The registered queries of the training-data operators against their SQL twins."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

from bandwright.llm import queries, twins


@pytest.mark.parametrize("name", sorted(twins.SQL))
def test_matches_sql(spark, folder, name):
    assert compare(queries.REGISTRY[name](spark, folder), connect(folder), twins.SQL[name]) is None


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.REGISTRY)
    assert numbers == list(range(1, 14)) and set(twins.SQL) <= set(queries.REGISTRY)
