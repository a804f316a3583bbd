from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from stratacart.operators import paging
from stratacart.schemas import GOLD
from stratacart.sources import files


@pytest.fixture
def stock(spark):
    """1000 products, a third with the same ratio, some without a name."""
    return spark.range(1000, numPartitions=7).select(
        F.col("id").cast("int").alias("product_id"),
        F.when(F.col("id") % 10 != 0, F.concat(F.lit("p"), F.col("id") % 13)).alias(
            "product_name"
        ),
        F.lit("c").alias("category"),
        F.lit(1).alias("stock_quantity"),
        F.col("id").alias("total_quantity_sold"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") % 50).cast("double")).alias(
            "stock_turnover_ratio"
        ),
    )


TABLE = "dm_stock_performance"


def daily(spark, *dates):
    return spark.createDataFrame(
        [(d, 1.0, 1, 1.0) for d in dates],
        "date date, total_revenue double, total_orders bigint, avg_order_value double",
    )


ONE, TWO = date(2024, 1, 1), date(2024, 1, 2)


def test_null_order(spark):
    df = daily(spark, ONE, None, TWO)
    with paging.prepare_pages(df, "dm_sales_daily") as down:
        assert [r.date for r in paging.gold_page(down).collect()] == [None, TWO, ONE]
    with paging.prepare_pages(df, "dm_sales_daily", order_dir="asc") as up:
        assert [r.date for r in paging.gold_page(up).collect()] == [ONE, TWO, None]


def all_pages(pages, size):
    last = -(-pages.total_rows // size)
    each = (paging.gold_page(pages, page, size) for page in range(1, last + 2))
    return [tuple(r) for page in each for r in page.collect()]


@pytest.mark.parametrize("how", [{}, {"order_by": "product_name", "order_dir": "asc"}])
def test_pages_make_up_the_sorted_table(stock, how):
    request = paging.validate_page(stock, TABLE, **how)
    expected = [tuple(r) for r in stock.orderBy(*paging._total_order(stock, request)).collect()]
    assert len(set(expected)) == 1000
    for parts in (None, 7):
        with paging.prepare_pages(stock, TABLE, **how, parts=parts) as pages:
            assert pages.total_rows == 1000
            assert all_pages(pages, 1000) == all_pages(pages, 170) == expected


def test_a_page_reads_its_rows_alone(spark, stock, executed_plan):
    with paging.prepare_pages(stock, TABLE, parts=7) as pages:
        page = paging.gold_page(pages, 9, 100)
        plan = executed_plan(page)
        assert "GreaterThanOrEqual(__position" in plan.split("PushedFilters: ")[1]
        assert "TakeOrderedAndProject" not in plan and "Window" not in plan
        scan = [part for part, before, rows in pages.parts if before < 900 and before + rows > 800]
        assert len(scan) < 4
        folder = pages.folder
    assert not files.exists(spark, folder)


def test_no_rows(spark):
    with paging.prepare_pages(daily(spark), "dm_sales_daily") as pages:
        assert paging.gold_page(pages).collect() == [] and pages.total_rows == 0


@pytest.mark.parametrize(
    "request_",
    [
        {"page": 0},
        {"page_size": 0},
        {"page_size": 1001},
        {"order_dir": "up"},
        {"table": "dm_unknown"},
        {"order_by": "nope"},
    ],
)
def test_bad_requests(stock, request_):
    with pytest.raises(paging.PageError):
        paging.validate_page(stock, **{"table": TABLE, **request_})


def test_defaults(stock):
    request = paging.validate_page(stock, TABLE)
    assert (request.page, request.page_size, request.order_by, request.order_dir) == (
        1,
        100,
        "stock_turnover_ratio",
        "desc",
    )


def test_page_info(spark, stock):
    info = paging.page_info(stock, TABLE, 2, 300, "product_id", "asc").head()
    assert (info["total_rows"], info["total_pages"]) == (1000, 4)
    assert (info["page"], info["order_by"], info["order_dir"]) == (2, "product_id", "asc")
    assert info["columns"] == stock.columns
    assert paging.page_info(daily(spark), "dm_sales_daily").head().total_pages == 0


def test_gold_tables(spark):
    listed = {r.table: r for r in paging.gold_tables(spark).collect()}
    assert set(listed) == set(GOLD)
    assert listed["dm_customer_metrics"].default_sort == "total_spent"
    assert listed["dm_sales_daily"].endpoint == "/gold/sales/daily"


def test_stored_gold(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS marts")
    with pytest.raises(paging.NotMaterialized):
        paging.stored_gold(spark, "marts", TABLE)
    with pytest.raises(paging.UnknownTable):
        paging.stored_gold(spark, "marts", "dm_unknown")
    daily(spark, ONE).write.saveAsTable("marts.dm_sales_daily")
    assert paging.stored_gold(spark, "marts", "dm_sales_daily").count() == 1
    spark.sql("DROP DATABASE marts CASCADE")
