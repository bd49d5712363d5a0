"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
import compare
from batchloom.plans import load_catalog

SF = "/root/testdata/sf0.001"
NAMES = list(load_catalog().QUERIES)


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    assert sql, "every query has SQL"
    assert compare.check(df, con, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
