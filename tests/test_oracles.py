"""Every registered query against its SQL, over the whole smallest tables."""

import pytest

import __spark_entry__ as driver
from articlelake.plans.catalog import QUERIES
from articlelake.plans.oracles import ORACLES
from oracle import difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    frame = driver.queries()[name](spark, FOLDER)
    assert difference(frame, FOLDER, driver.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())
