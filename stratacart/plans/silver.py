"""Raw tables to typed, deduplicated, referentially clean dimensions and facts.

The order of the steps is part of the result: a row that fails a filter cannot win
its duplicate group, and a winner without a valid foreign key takes its key with it.

``counts`` sees the rows as they pass between the steps; see ``operators.counts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacart.functions.casts import cast_columns, cast_fields
from stratacart.functions.scalars import date_parts, line_amount
from stratacart.operators.counts import DISTINCT, FILTERED, IN, Counted, uncounted
from stratacart.operators.joins import fk_enrich, fk_filter
from stratacart.operators.quality import (
    dedup_by_key,
    distinct_values,
    require_between,
    require_key,
    require_positive,
)
from stratacart.schemas import BRONZE, SILVER, columns


_RAW = "__raw_"


def _cast(df: DataFrame, source: str, key_type: str, counts: Counted) -> DataFrame:
    """The typed columns of a raw table; what could not be cast is counted on the way."""
    fields = BRONZE[source]
    if counts is uncounted:
        return cast_fields(df, fields, key_type)
    typed = cast_columns(df.schema, fields, key_type)
    both = df.select(*typed.values(), *(F.col(n).alias(_RAW + n) for n in typed))
    lost = {
        f"bad_{n}": F.col(n).isNull() & F.col(_RAW + n).isNotNull()
        for n, kind in fields
        if kind != "string"
    }
    return counts(both, IN, lost).select(*typed)


def _in_written_order(df: DataFrame, table: str) -> DataFrame:
    return df.select(*columns(SILVER[table]))


def dim_customers(
    customers: DataFrame, key_type: str = "bigint", *, counts: Counted = uncounted
) -> DataFrame:
    return (
        customers.transform(_cast, "customers", key_type, counts)
        .transform(require_key, "customer_id")
        .transform(counts, FILTERED)
        .transform(dedup_by_key, "customer_id")
        .transform(counts, DISTINCT)
    )


def dim_products(
    products: DataFrame, key_type: str = "bigint", *, counts: Counted = uncounted
) -> DataFrame:
    return (
        products.transform(_cast, "products", key_type, counts)
        .transform(require_key, "product_id")
        .transform(counts, FILTERED)
        .transform(dedup_by_key, "product_id")
        .transform(counts, DISTINCT)
    )


def fact_orders(
    orders: DataFrame,
    customers: DataFrame,
    key_type: str = "bigint",
    salt: int = 1,
    *,
    counts: Counted = uncounted,
) -> DataFrame:
    """Orders with a positive amount and a known customer; ``customers`` is dim_customers."""
    return (
        orders.transform(_cast, "orders", key_type, counts)
        .transform(require_positive, "total_amount")
        .transform(counts, FILTERED)
        .transform(dedup_by_key, "order_id")
        .transform(counts, DISTINCT)
        .transform(fk_filter, customers, "customer_id", salt)
        .transform(_in_written_order, "fact_orders")
    )


def fact_order_items(
    items: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    key_type: str = "bigint",
    salt: int = 1,
    *,
    counts: Counted = uncounted,
) -> DataFrame:
    """Items of known orders and products, dated by their order; ``orders`` is fact_orders
    and ``products`` dim_products.

    The two key checks commute. Products go first: that side is often small enough to be
    broadcast, and then fewer rows travel to the join with orders. Orders are a fact and are
    merged: Spark goes by the bytes of their files, and a few megabytes of packed columns are
    millions of rows, which a broadcast would send through the driver.
    """
    return (
        items.transform(_cast, "order_items", key_type, counts)
        .transform(require_positive, "quantity", "unit_price")
        .transform(counts, FILTERED)
        .transform(dedup_by_key, "order_item_id")
        .transform(counts, DISTINCT)
        .transform(fk_filter, products, "product_id", salt)
        .transform(fk_enrich, orders.hint("merge"), "order_id", "order_date", salt=salt)
        .withColumn("line_amount", line_amount(F.col("quantity"), F.col("unit_price")))
        .transform(_in_written_order, "fact_order_items")
    )


def fact_reviews(
    reviews: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    key_type: str = "bigint",
    salt: int = 1,
    *,
    counts: Counted = uncounted,
) -> DataFrame:
    """Reviews rated 1 to 5 of known products by known customers."""
    return (
        reviews.transform(_cast, "product_reviews", key_type, counts)
        .transform(require_between, "rating", 1, 5)
        .transform(counts, FILTERED)
        .transform(dedup_by_key, "review_id")
        .transform(counts, DISTINCT)
        .transform(fk_filter, products, "product_id", salt)
        .transform(fk_filter, customers, "customer_id", salt)
        .transform(_in_written_order, "fact_reviews")
    )


def dim_date(orders: DataFrame) -> DataFrame:
    """The calendar of the order dates in fact_orders; orders without a date give a NULL row."""
    return (
        orders.transform(distinct_values, "order_date", "date_key")
        .withColumns(date_parts(F.col("date_key")))
        .transform(_in_written_order, "dim_date")
    )
