"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catamatch.plans.oracle import SQL
from catamatch.plans.queries import REGISTRY
from compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(SQL)
    assert set(REGISTRY) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    n, diff = differences(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert not diff
    assert n > 0
