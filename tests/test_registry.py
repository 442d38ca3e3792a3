"""Every registered query against its SQL twin on the smallest data."""

import pytest

import __spark_entry__ as driver
from tallyweave.plans.registry import load_all
from tools.check_oracle import check, connect

SF_DIR = "/root/testdata/sf0.001"
REGISTRY = load_all()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, duck, name):
    problems, _ = check(spark, duck, REGISTRY[name], SF_DIR)
    if REGISTRY[name].oracle is None and problems == ["no rows"]:
        pytest.fail("no rows")
    assert not problems


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
