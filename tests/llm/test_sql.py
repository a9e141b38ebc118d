"""Queries of this subpackage that SQL can express, whole tables against DuckDB."""

import pytest

from catamatch.llm.queries import REGISTRY, SQL
from compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    n, diff = differences(spark, connect(SF), REGISTRY[name], SQL[name], SF)
    assert not diff and n > 0
