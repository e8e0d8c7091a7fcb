"""Every registered query with SQL against an independent engine."""

import compare
import pytest

import __spark_entry__ as driver
from rollbook.plans import oracle, registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(oracle.oracle_sql()) == set(registry.queries())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["ticker", "pnl_1", "ret_1", "pnl_2", "ret_2"]


@pytest.mark.parametrize("name", list(driver.oracle_sql()))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    got = compare.spark_rows(df)
    columns, want = compare.duck_rows(duck, driver.oracle_sql()[name])
    assert sorted(df.columns) == sorted(columns)
    assert got == want
    assert got
