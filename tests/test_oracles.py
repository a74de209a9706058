"""Every registered query against its oracle, on the smallest tables."""

import pytest
from conftest import TABLES
from oracle import compare, connect

from keyhound.plans import all_oracles, all_queries


@pytest.fixture(scope="module")
def duck():
    return connect(TABLES)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    rows, problem = compare(spark, duck, TABLES, all_queries()[name], all_oracles().get(name))
    assert problem is None
    assert rows >= 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
