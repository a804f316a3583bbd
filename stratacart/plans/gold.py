"""The five datamarts.

Facts are aggregated to one row per key before they meet a dimension, so no join here
sees a hot key. Where a dimension holds several copies of a key (all ingest dates read
together) the join repeats the aggregate per copy, and the grouping that follows, on
columns led by the join key and hence without another shuffle, adds the copies up.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacart.functions.casts import to_date_lenient
from stratacart.functions.scalars import safe_ratio
from stratacart.operators.aggregates import order_totals, product_sales, review_stats
from stratacart.operators.joins import left_enrich

# Both sides hold a row per key and ingest date: nothing to spread.
_join_per_key = partial(left_enrich, salt=None)


def dm_sales_daily(orders: DataFrame, unique_ids: bool = False) -> DataFrame:
    """Revenue, distinct orders and average order value per day."""
    days = orders.withColumn("date", to_date_lenient(F.col("order_date")))
    return order_totals(days, "date", "total_revenue", unique_ids).select(
        "date",
        "total_revenue",
        "total_orders",
        safe_ratio(F.col("total_revenue"), F.col("total_orders")).alias("avg_order_value"),
    )


def dm_sales_by_product(
    items: DataFrame, products: DataFrame, sales: DataFrame | None = None
) -> DataFrame:
    """Quantity and revenue per sold product. ``sales`` is product_sales(items), if at hand."""
    sales = product_sales(items) if sales is None else sales
    return (
        _join_per_key(sales, products, "product_id", "product_name", "category", "brand")
        .groupBy("product_id", "product_name", "category", "brand")
        .agg(
            F.sum("total_quantity_sold").alias("total_quantity_sold"),
            F.sum("total_revenue").alias("total_revenue"),
        )
    )


def dm_customer_metrics(
    orders: DataFrame, customers: DataFrame, unique_ids: bool = False
) -> DataFrame:
    """Orders, spending, first and last order date per customer with orders."""
    totals = order_totals(orders, "customer_id", "total_spent", unique_ids)
    per_country = (
        _join_per_key(totals, customers, "customer_id", "country")
        .groupBy("customer_id", "country")
        .agg(
            F.max("total_orders").alias("total_orders"),
            F.sum("total_spent").alias("total_spent"),
            F.min("first_order_date").alias("first_order_date"),
            F.max("last_order_date").alias("last_order_date"),
        )
    )
    ratio = safe_ratio(F.col("total_spent"), F.col("total_orders"))
    return per_country.withColumn("avg_order_value", ratio)


def dm_product_reviews_impact(
    products: DataFrame,
    reviews: DataFrame,
    items: DataFrame,
    sales: DataFrame | None = None,
    unique_ids: bool = False,
) -> DataFrame:
    """Rating and revenue of every product, zeros where it has no review or sale."""
    sales = product_sales(items) if sales is None else sales
    named = products.select("product_id", "product_name")
    rated = _join_per_key(
        named, review_stats(reviews, unique_ids), "product_id", "avg_rating", "nb_reviews"
    )
    return _join_per_key(rated, sales, "product_id", "total_revenue").na.fill(
        {"avg_rating": 0.0, "nb_reviews": 0, "total_revenue": 0.0}
    )


def dm_stock_performance(
    products: DataFrame, items: DataFrame, sales: DataFrame | None = None
) -> DataFrame:
    """Sold quantity against stock of every product."""
    sales = product_sales(items) if sales is None else sales
    stock = products.select("product_id", "product_name", "category", "stock_quantity")
    sold = _join_per_key(stock, sales, "product_id", "total_quantity_sold").na.fill(
        {"total_quantity_sold": 0}
    )
    ratio = safe_ratio(F.col("total_quantity_sold"), F.col("stock_quantity"))
    return sold.withColumn("stock_turnover_ratio", ratio)
