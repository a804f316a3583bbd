"""Every registered query against its SQL."""

from __future__ import annotations

import __spark_entry__ as driver
import compare
import pytest
from oracles import queries as registered

# Pages that start behind the last row of the smallest test tables.
EMPTY_AT_SMALL_SCALE = {"page_customer_metrics", "page_deep", "page_nulls_last"}


@pytest.fixture(scope="module")
def duck():
    return compare.duck("/root/testdata/sf0.001")


NAMES = sorted(registered.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    query, sql = registered.QUERIES[name], registered.SQL[name]
    allowed = {"", "no rows"} if name in EMPTY_AT_SMALL_SCALE else {""}
    assert compare.difference(spark, duck, sf_dir, query, sql) in allowed


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["date", "total_revenue", "total_orders", "avg_order_value"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(NAMES) == set(registered.SQL)
    assert set(NAMES) <= set(driver.queries())
