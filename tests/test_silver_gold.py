from __future__ import annotations

from datetime import date

import pytest
from oracles import adapter
from oracles.queries import DATAMARTS, KEY_TYPE, Silver
from pyspark.sql import functions as F

from stratacart.plans import gold, silver
from stratacart.schemas import BRONZE, GOLD, SILVER, columns, spark_type


def raw(spark, table, *rows):
    schema = ", ".join(f"{c} string" for c in columns(BRONZE[table]))
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def customers(spark):
    return silver.dim_customers(
        raw(
            spark,
            "customers",
            ("1", "f", "FR", "2024-01-05"),
            ("1.9", "f", "DE", "2024-01-05"),
            ("2", None, None, "junk"),
            ("x", "m", "FR", "2024-01-05"),
        )
    )


@pytest.fixture
def products(spark):
    return silver.dim_products(
        raw(
            spark,
            "products",
            ("10", "pen", "office", "b1", "1.5", "4"),
            ("11", "cup", "home", "b2", "bad", "0"),
            ("12", "hat", "wear", None, "9", "none"),
        )
    )


@pytest.fixture
def orders(spark, customers):
    return silver.fact_orders(
        raw(
            spark,
            "orders",
            ("100", "1", "2024-01-01", "10.5", "card", "FR"),
            # A failing copy cannot win the duplicate group.
            ("101", "1", "2024-01-01", "-1", "a", "FR"),
            ("101", "1", "2024-01-02", "20", "card", "FR"),
            # The winner (customer 0 sorts first) has no parent: the key is gone.
            ("102", "0", "2024-01-01", "5", "card", "FR"),
            ("102", "1", "2024-01-01", "5", "card", "FR"),
            # Unreadable keys form one group.
            ("?", "2", "2024-01-03", "7", "card", "FR"),
            ("!", "2", None, "8", "card", "FR"),
            ("103", "1", "2024-01-01", None, "card", "FR"),
            ("104", None, "2024-01-01", "3", "card", "FR"),
        ),
        customers,
    )


@pytest.fixture
def items(spark, orders, products):
    return silver.fact_order_items(
        raw(
            spark,
            "order_items",
            ("1", "100", "10", "2", "1.5"),
            ("2", "100", "11", "1", "4"),
            ("3", "101", "10", "3.9", "1.5"),
            ("4", "102", "10", "1", "1.5"),
            ("5", "100", "99", "1", "1.5"),
            ("6", "100", "10", "0", "1.5"),
            ("7", None, "10", "1", "1.5"),
        ),
        orders,
        products,
    )


@pytest.fixture
def reviews(spark, products, customers):
    return silver.fact_reviews(
        raw(
            spark,
            "product_reviews",
            ("1", "10", "1", "5.9", "2024-02-01"),
            ("2", "10", "2", "2", "bad"),
            ("3", "10", "1", "6", "2024-02-01"),
            ("4", "99", "1", "3", "2024-02-01"),
            ("5", "10", "9", "3", "2024-02-01"),
        ),
        products,
        customers,
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(v is not None, v) for v in r])


NEW_YEAR, SECOND = date(2024, 1, 1), date(2024, 1, 2)


def test_dim_customers(customers):
    assert rows(customers) == [
        (1, "f", "DE", date(2024, 1, 5)),
        (2, None, None, None),
    ]


def test_fact_orders(orders):
    assert rows(orders) == [
        (1, 100, NEW_YEAR, 10.5, "card", "FR"),
        (1, 101, SECOND, 20.0, "card", "FR"),
        (2, None, None, 8.0, "card", "FR"),
    ]


def test_fact_order_items(items):
    assert rows(items) == [
        (10, 100, 1, 2, 1.5, NEW_YEAR, 3.0),
        (10, 101, 3, 3, 1.5, SECOND, 4.5),
        (11, 100, 2, 1, 4.0, NEW_YEAR, 4.0),
    ]


def test_fact_reviews(reviews):
    assert rows(reviews) == [(1, 10, 1, 5, date(2024, 2, 1)), (2, 10, 2, 2, None)]


def test_dim_date(orders):
    assert rows(silver.dim_date(orders)) == [
        (None,) * 6,
        (NEW_YEAR, 2024, 1, 1, 1, 1),
        (SECOND, 2024, 1, 2, 1, 1),
    ]


def test_dm_sales_daily(orders):
    assert rows(gold.dm_sales_daily(orders)) == [
        (None, 8.0, 0, 0.0),
        (NEW_YEAR, 10.5, 1, 10.5),
        (SECOND, 20.0, 1, 20.0),
    ]


def test_dm_sales_by_product(items, products):
    assert rows(gold.dm_sales_by_product(items, products)) == [
        (10, "pen", "office", "b1", 5, 7.5),
        (11, "cup", "home", "b2", 1, 4.0),
    ]


def test_dm_customer_metrics(orders, customers):
    assert rows(gold.dm_customer_metrics(orders, customers)) == [
        (1, "DE", 2, 30.5, NEW_YEAR, SECOND, 15.25),
        (2, None, 0, 8.0, None, None, 0.0),
    ]


def test_dm_product_reviews_impact(products, reviews, items):
    assert rows(gold.dm_product_reviews_impact(products, reviews, items)) == [
        (10, "pen", 3.5, 2, 7.5),
        (11, "cup", 0.0, 0, 4.0),
        (12, "hat", 0.0, 0, 0.0),
    ]


def test_dm_stock_performance(products, items):
    assert rows(gold.dm_stock_performance(products, items)) == [
        (10, "pen", "office", 4, 5, 1.25),
        (11, "cup", "home", 0, 1, 0.0),
        (12, "hat", "wear", None, 0, 0.0),
    ]


def test_changed_attributes_split_a_product_over_all_dates(spark, items, products):
    renamed = products.withColumn("brand", F.lit("new")).where("product_id = 10")
    result = gold.dm_sales_by_product(items, products.union(renamed))
    assert rows(result.where("product_id = 10").select("brand", "total_quantity_sold")) == [
        ("b1", 5),
        ("new", 5),
    ]


GOLD_TYPES = {
    "dm_sales_daily": "date date, total_revenue double, total_orders bigint, "
    "avg_order_value double",
    "dm_sales_by_product": "product_id bigint, product_name string, category string, "
    "brand string, total_quantity_sold bigint, total_revenue double",
    "dm_customer_metrics": "customer_id bigint, country string, total_orders bigint, "
    "total_spent double, first_order_date date, last_order_date date, avg_order_value double",
    "dm_product_reviews_impact": "product_id bigint, product_name string, avg_rating double, "
    "nb_reviews bigint, total_revenue double",
    "dm_stock_performance": "product_id bigint, product_name string, category string, "
    "stock_quantity int, total_quantity_sold bigint, stock_turnover_ratio double",
}


def kinds(df):
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def test_schemas(orders, items, reviews, customers, products):
    tables = {
        "dim_customers": customers,
        "dim_products": products,
        "dim_date": silver.dim_date(orders),
        "fact_orders": orders,
        "fact_order_items": items,
        "fact_reviews": reviews,
    }
    for name, fields in SILVER.items():
        assert tables[name].dtypes == [(n, spark_type(t)) for n, t in fields], name
    marts = {
        "dm_sales_daily": gold.dm_sales_daily(orders),
        "dm_sales_by_product": gold.dm_sales_by_product(items, products),
        "dm_customer_metrics": gold.dm_customer_metrics(orders, customers),
        "dm_product_reviews_impact": gold.dm_product_reviews_impact(products, reviews, items),
        "dm_stock_performance": gold.dm_stock_performance(products, items),
    }
    assert set(marts) == set(GOLD)
    assert {n: kinds(df) for n, df in marts.items()} == GOLD_TYPES


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    """The silver tables of the dirty test data, stored once for the properties below."""
    root = str(tmp_path_factory.mktemp("dirty"))
    tables = Silver(spark, "/root/testdata/sf0.001", True)
    for name in SILVER:
        getattr(tables, name).write.parquet(f"{root}/{name}")
    return lambda name: spark.read.parquet(f"{root}/{name}")


def test_keys_are_unique(dirty):
    for name, key in {
        "dim_customers": "customer_id",
        "dim_products": "product_id",
        "dim_date": "date_key",
        "fact_orders": "order_id",
        "fact_order_items": "order_item_id",
        "fact_reviews": "review_id",
    }.items():
        df = dirty(name)
        assert df.count() == df.select(key).distinct().count() > 0, name


def test_foreign_keys_exist(dirty):
    for child, parent, key in (
        ("fact_orders", "dim_customers", "customer_id"),
        ("fact_order_items", "fact_orders", "order_id"),
        ("fact_order_items", "dim_products", "product_id"),
        ("fact_reviews", "dim_products", "product_id"),
        ("fact_reviews", "dim_customers", "customer_id"),
    ):
        orphans = dirty(child).join(dirty(parent).select(key), key, "left_anti")
        assert orphans.count() == 0, (child, key)


def total(df, name):
    return df.agg(F.sum(name)).first()[0]


def test_totals_agree(dirty):
    orders, items = dirty("fact_orders"), dirty("fact_order_items")
    daily = gold.dm_sales_daily(orders)
    spent = gold.dm_customer_metrics(orders, dirty("dim_customers"))
    by_product = gold.dm_sales_by_product(items, dirty("dim_products"))
    assert total(daily, "total_revenue") == pytest.approx(total(orders, "total_amount"))
    assert total(spent, "total_spent") == pytest.approx(total(orders, "total_amount"))
    assert total(by_product, "total_revenue") == pytest.approx(total(items, "line_amount"))
    assert total(by_product, "total_quantity_sold") == total(items, "quantity")


def test_silver_ignores_row_order_and_partitioning(spark, sf_dir, dirty):
    def shuffled(name):
        return adapter.BRONZE[name](spark, sf_dir, True).repartition(13, F.rand(7))

    customers = silver.dim_customers(shuffled("customers"), KEY_TYPE)
    orders = silver.fact_orders(shuffled("orders"), customers, KEY_TYPE, salt=3)
    products = silver.dim_products(shuffled("products"), KEY_TYPE)
    items = silver.fact_order_items(
        shuffled("order_items"), orders, products, KEY_TYPE, salt=3
    )
    assert rows(orders) == rows(dirty("fact_orders"))
    assert rows(items) == rows(dirty("fact_order_items"))


def test_unique_ids_changes_nothing_on_a_single_date(dirty):
    orders, customers = dirty("fact_orders"), dirty("dim_customers")
    for make in (gold.dm_sales_daily, lambda o, **k: gold.dm_customer_metrics(o, customers, **k)):
        exact = make(orders).select("total_orders").groupBy("total_orders").count()
        counted = make(orders, unique_ids=True).select("total_orders").groupBy("total_orders")
        assert rows(exact) == rows(counted.count())


def test_datamarts_cover_the_registry():
    assert set(DATAMARTS) == set(GOLD)
