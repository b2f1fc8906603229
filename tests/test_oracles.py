"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

from rolemill import catalog
from rolemill.catalog.registry import ORACLES, QUERIES
from tests.conftest import SF_DIR
from tests.oracle import connect, difference

catalog.load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert difference(df, duck, ORACLES[name]) == ""
    else:
        df.collect()


def test_driver_contract(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
