"""Names, types and keys of the bronze, silver and gold tables.

A field type is a Spark SQL type name or ``KEY``, which stands for the type of
the identifiers: ``bigint`` unless the caller asks for ``int``.
"""

from __future__ import annotations

from dataclasses import dataclass

KEY = "key"
KEY_TYPES = ("int", "bigint")

Fields = tuple[tuple[str, str], ...]

BRONZE_PARTITION = ("year", "month", "day")
SILVER_PARTITION = ("ingest_year", "ingest_month", "ingest_day")

# The columns each raw table must have, with the types they get.
BRONZE: dict[str, Fields] = {
    "customers": (
        ("customer_id", KEY),
        ("gender", "string"),
        ("country", "string"),
        ("signup_date", "date"),
    ),
    "products": (
        ("product_id", KEY),
        ("product_name", "string"),
        ("category", "string"),
        ("brand", "string"),
        ("price", "double"),
        ("stock_quantity", "int"),
    ),
    "orders": (
        ("order_id", KEY),
        ("customer_id", KEY),
        ("order_date", "date"),
        ("total_amount", "double"),
        ("payment_method", "string"),
        ("shipping_country", "string"),
    ),
    "order_items": (
        ("order_item_id", KEY),
        ("order_id", KEY),
        ("product_id", KEY),
        ("quantity", "int"),
        ("unit_price", "double"),
    ),
    "product_reviews": (
        ("review_id", KEY),
        ("product_id", KEY),
        ("customer_id", KEY),
        ("rating", "int"),
        ("review_date", "date"),
    ),
}

# Silver columns in the order they are written.
SILVER: dict[str, Fields] = {
    "dim_customers": BRONZE["customers"],
    "dim_products": BRONZE["products"],
    "dim_date": (
        ("date_key", "date"),
        ("year", "int"),
        ("month", "int"),
        ("day", "int"),
        ("week", "int"),
        ("quarter", "int"),
    ),
    "fact_orders": (
        ("customer_id", KEY),
        ("order_id", KEY),
        ("order_date", "date"),
        ("total_amount", "double"),
        ("payment_method", "string"),
        ("shipping_country", "string"),
    ),
    "fact_order_items": (
        ("product_id", KEY),
        ("order_id", KEY),
        ("order_item_id", KEY),
        ("quantity", "int"),
        ("unit_price", "double"),
        ("order_date", "date"),
        ("line_amount", "double"),
    ),
    "fact_reviews": (
        ("customer_id", KEY),
        ("product_id", KEY),
        ("review_id", KEY),
        ("rating", "int"),
        ("review_date", "date"),
    ),
}

# The column of each silver table that no two of its rows share.
SILVER_KEYS = {
    "dim_customers": "customer_id",
    "dim_products": "product_id",
    "dim_date": "date_key",
    "fact_orders": "order_id",
    "fact_order_items": "order_item_id",
    "fact_reviews": "review_id",
}

#: Silver tables the datamarts read; dim_date serves outside tools only.
GOLD_INPUTS = ("fact_orders", "fact_order_items", "fact_reviews", "dim_products", "dim_customers")


@dataclass(frozen=True)
class Datamart:
    """One gold table: its grain, the sort of its pages and where they are published."""

    key: tuple[str, ...]
    default_sort: str
    endpoint: str


# The published datamarts.
GOLD: dict[str, Datamart] = {
    "dm_sales_daily": Datamart(("date",), "date", "/gold/sales/daily"),
    "dm_sales_by_product": Datamart(
        ("product_id", "product_name", "category", "brand"),
        "total_revenue",
        "/gold/sales/by-product",
    ),
    "dm_customer_metrics": Datamart(
        ("customer_id", "country"), "total_spent", "/gold/customers/metrics"
    ),
    "dm_product_reviews_impact": Datamart(
        ("product_id",), "total_revenue", "/gold/products/reviews-impact"
    ),
    "dm_stock_performance": Datamart(
        ("product_id",), "stock_turnover_ratio", "/gold/stock/performance"
    ),
}


def columns(fields: Fields) -> list[str]:
    return [name for name, _ in fields]


def spark_type(field_type: str, key_type: str = "bigint") -> str:
    if key_type not in KEY_TYPES:
        raise ValueError(f"key_type must be one of {KEY_TYPES}, not {key_type!r}")
    return key_type if field_type == KEY else field_type


def ddl(fields: Fields, key_type: str = "bigint") -> str:
    """The fields as a DDL column list, as readers and CREATE TABLE take it."""
    return ", ".join(f"`{name}` {spark_type(kind, key_type)}" for name, kind in fields)
