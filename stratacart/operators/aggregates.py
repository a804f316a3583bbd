"""Aggregates of the facts, each to one row per key.

Sums, extremes and averages combine map-side. An exact distinct count is planned by
Catalyst as a first grouping by (key, id), so a hot key is spread by its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacart.functions.casts import to_date_lenient


def order_totals(orders: DataFrame, by: str, amount: str, unique_ids: bool = False) -> DataFrame:
    """Revenue and distinct orders per ``by``, with the first and last order date.

    ``unique_ids`` tells that no order_id repeats in ``orders``, as holds for a silver
    partition written in overwrite mode; counting then needs no shuffle of its own.
    """
    ids = F.count("order_id") if unique_ids else F.count_distinct("order_id")
    day = to_date_lenient(F.col("order_date"))
    return orders.groupBy(by).agg(
        F.sum("total_amount").alias(amount),
        ids.alias("total_orders"),
        F.min(day).alias("first_order_date"),
        F.max(day).alias("last_order_date"),
    )


def product_sales(items: DataFrame) -> DataFrame:
    """Quantity and revenue sold per product."""
    return items.groupBy("product_id").agg(
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum("line_amount").alias("total_revenue"),
    )


def review_stats(reviews: DataFrame, unique_ids: bool = False) -> DataFrame:
    """Average rating and distinct reviews per product."""
    ids = F.count("review_id") if unique_ids else F.count_distinct("review_id")
    return reviews.groupBy("product_id").agg(
        F.avg("rating").alias("avg_rating"), ids.alias("nb_reviews")
    )
