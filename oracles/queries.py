"""Every operator and table as a query over the test tables, paired with its SQL.

Identifiers are bigint here, as in the test tables. Sums of doubles are rounded, since
the order of adding shows in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date
from functools import cached_property, lru_cache, reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oracles import adapter
from oracles import sql as text
from stratacart.functions.casts import cast_fields, to_bigint, to_date_lenient, to_double, to_int
from stratacart.functions.scalars import date_parts, line_amount, safe_ratio
from stratacart.operators import paging
from stratacart.operators.aggregates import order_totals, product_sales, review_stats
from stratacart.operators.joins import fk_enrich, fk_filter, left_enrich
from stratacart.operators.quality import (
    dedup_by_key,
    distinct_values,
    require_between,
    require_key,
    require_positive,
)
from stratacart.plans import gold, jobs, silver
from stratacart.schemas import BRONZE, GOLD, SILVER, SILVER_PARTITION, columns
from stratacart.sources import catalog, lake
from stratacart.sources.landing import read_csv
from stratacart.sources.scratch import scratch_path

KEY_TYPE = "bigint"
MONEY = ("total_revenue", "total_spent", "total_amount_sum")
RATIOS = ("avg_rating", "stock_turnover_ratio")
DAY_ONE, DAY_TWO = date(2024, 1, 31), date(2024, 2, 1)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name or function.__name__] = function
        SQL[name or function.__name__] = sql
        return function

    return register


def money(total: Column) -> Column:
    """A sum of amounts in cents, rounded to these, so that the order of adding does not show."""
    return F.round(total, 2)


def rounded(df: DataFrame) -> DataFrame:
    """Round what depends on the order of adding: sums to cents, ratios to six decimals and
    averages of sums to twelve significant digits."""
    df = df.withColumns({c: money(F.col(c)) for c in df.columns if c in MONEY})
    df = df.withColumns({c: F.round(c, 6) for c in df.columns if c in RATIOS})
    digits = F.format_string("%.11e", "avg_order_value").cast("double")
    return df.withColumns({c: digits for c in df.columns if c == "avg_order_value"})


def typed(spark: SparkSession, sf_dir: str, name: str, dirty: bool = True) -> DataFrame:
    raw = adapter.BRONZE[name](spark, sf_dir, dirty)
    return cast_fields(raw, BRONZE[name], KEY_TYPE)


class Silver:
    """The silver tables over the test tables; a table's plan is made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, dirty: bool) -> None:
        self._raw = lambda name: adapter.BRONZE[name](spark, sf_dir, dirty)

    @cached_property
    def dim_customers(self) -> DataFrame:
        return silver.dim_customers(self._raw("customers"), KEY_TYPE)

    @cached_property
    def dim_products(self) -> DataFrame:
        return silver.dim_products(self._raw("products"), KEY_TYPE)

    @cached_property
    def dim_date(self) -> DataFrame:
        return silver.dim_date(self.fact_orders)

    @cached_property
    def fact_orders(self) -> DataFrame:
        return silver.fact_orders(self._raw("orders"), self.dim_customers, KEY_TYPE)

    @cached_property
    def fact_order_items(self) -> DataFrame:
        return silver.fact_order_items(
            self._raw("order_items"), self.fact_orders, self.dim_products, KEY_TYPE
        )

    @cached_property
    def fact_reviews(self) -> DataFrame:
        return silver.fact_reviews(
            self._raw("product_reviews"), self.dim_products, self.dim_customers, KEY_TYPE
        )


DATAMARTS: dict[str, Callable[[Silver], DataFrame]] = {
    "dm_sales_daily": lambda s: gold.dm_sales_daily(s.fact_orders),
    "dm_sales_by_product": lambda s: gold.dm_sales_by_product(
        s.fact_order_items, s.dim_products
    ),
    "dm_customer_metrics": lambda s: gold.dm_customer_metrics(s.fact_orders, s.dim_customers),
    "dm_product_reviews_impact": lambda s: gold.dm_product_reviews_impact(
        s.dim_products, s.fact_reviews, s.fact_order_items
    ),
    "dm_stock_performance": lambda s: gold.dm_stock_performance(
        s.dim_products, s.fact_order_items
    ),
}


def gold_table(spark: SparkSession, sf_dir: str, dirty: bool, name: str) -> DataFrame:
    return rounded(DATAMARTS[name](Silver(spark, sf_dir, dirty)))


# Silver and gold tables, from clean and from dirty input.


def _register_tables() -> None:
    for dirty, suffix in ((False, ""), (True, "_dirty")):
        for name in SILVER:
            QUERIES[name + suffix] = lambda spark, sf_dir, d=dirty, n=name: getattr(
                Silver(spark, sf_dir, d), n
            )
            SQL[name + suffix] = text.with_silver(dirty, f"SELECT * FROM {name}")
        for name in GOLD:
            QUERIES[name + suffix] = lambda spark, sf_dir, d=dirty, n=name: gold_table(
                spark, sf_dir, d, n
            )
            SQL[name + suffix] = text.with_gold(dirty, f"SELECT * FROM {name}")


_register_tables()


# Pages of the datamarts.

_PAGES: dict[str, tuple[str, bool, dict, str]] = {
    "page_sales_daily": ("dm_sales_daily", False, {}, "date DESC NULLS FIRST LIMIT 100"),
    "page_sales_by_product": (
        "dm_sales_by_product",
        False,
        {"page": 2, "page_size": 50},
        "total_revenue DESC NULLS FIRST, product_id LIMIT 50 OFFSET 50",
    ),
    "page_customer_metrics": (
        "dm_customer_metrics",
        False,
        {"page": 3},
        "total_spent DESC NULLS FIRST, customer_id LIMIT 100 OFFSET 200",
    ),
    "page_reviews_impact": (
        "dm_product_reviews_impact",
        False,
        {"page_size": 1000},
        "total_revenue DESC NULLS FIRST, product_id LIMIT 1000",
    ),
    "page_stock_performance": (
        "dm_stock_performance",
        False,
        {"page": 2},
        "stock_turnover_ratio DESC NULLS FIRST, product_id LIMIT 100 OFFSET 100",
    ),
    "page_nulls_first": (
        "dm_customer_metrics",
        True,
        {"order_by": "country", "page_size": 200},
        "country DESC NULLS FIRST, customer_id LIMIT 200",
    ),
    "page_nulls_last": (
        "dm_sales_daily",
        True,
        {"order_by": "date", "order_dir": "asc", "page": 2, "page_size": 1000},
        "date ASC NULLS LAST LIMIT 1000 OFFSET 1000",
    ),
}


def _page(df: DataFrame, table: str, page: int = 1, page_size: int = 100, **how) -> DataFrame:
    return paging.gold_page(paging.prepare_pages(df, table, **how), page, page_size)


def _register_pages() -> None:
    for name, (table, dirty, request, clause) in _PAGES.items():
        QUERIES[name] = lambda spark, sf_dir, t=table, d=dirty, r=request: _page(
            gold_table(spark, sf_dir, d, t), t, **r
        )
        SQL[name] = text.with_gold(dirty, f"SELECT * FROM {table} ORDER BY {clause}")


_register_pages()


_DEEP = {"order_by": "first_order_date", "order_dir": "asc"}


@query(
    text.with_gold(
        False,
        "SELECT * FROM dm_customer_metrics "
        "ORDER BY first_order_date ASC NULLS LAST, customer_id LIMIT 600 OFFSET 200",
    )
)
def page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages that lie in several of the sorted parts."""
    df = gold_table(spark, sf_dir, False, "dm_customer_metrics")
    pages = paging.prepare_pages(df, "dm_customer_metrics", **_DEEP, parts=8)
    return reduce(DataFrame.union, [paging.gold_page(pages, n, 200) for n in (2, 3, 4)])


def _info_sql(name: str, page: int, size: int, sort: str, direction: str) -> str:
    return (
        f"SELECT '{name}' AS \"table\", {page} AS page, {size} AS page_size, "
        f"count(*) AS total_rows, (count(*) + {size - 1}) // {size} AS total_pages, "
        f"'{sort}' AS order_by, '{direction}' AS order_dir, "
        f"'{_COLUMNS[name]}' AS columns FROM {name}"
    )


# The columns of the datamarts in their published order.
_COLUMNS = {
    "dm_sales_daily": "date,total_revenue,total_orders,avg_order_value",
    "dm_sales_by_product": (
        "product_id,product_name,category,brand,total_quantity_sold,total_revenue"
    ),
    "dm_customer_metrics": (
        "customer_id,country,total_orders,total_spent,first_order_date,last_order_date,"
        "avg_order_value"
    ),
    "dm_product_reviews_impact": "product_id,product_name,avg_rating,nb_reviews,total_revenue",
    "dm_stock_performance": (
        "product_id,product_name,category,stock_quantity,total_quantity_sold,"
        "stock_turnover_ratio"
    ),
}
_INFO_REQUEST = {"page": 3, "page_size": 7, "order_by": "country", "order_dir": "asc"}


@query(
    text.with_gold(
        False,
        " UNION ALL ".join(
            [_info_sql(name, 1, 100, mart.default_sort, "desc") for name, mart in GOLD.items()]
            + [_info_sql("dm_customer_metrics", 3, 7, "country", "asc")]
        ),
    )
)
def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the default request of each datamart and for another one; one lazy plan."""
    tables = Silver(spark, sf_dir, False)
    infos = [paging.page_info(make(tables), name) for name, make in DATAMARTS.items()]
    customers = DATAMARTS["dm_customer_metrics"](tables)
    infos.append(paging.page_info(customers, "dm_customer_metrics", **_INFO_REQUEST))
    together = reduce(DataFrame.unionByName, infos)
    return together.withColumn("columns", F.array_join("columns", ","))


# Casts and scalar functions.


@query("""
SELECT event_id,
       CASE event_id % 8 WHEN 0 THEN CAST(trunc(value) AS INTEGER)
            WHEN 1 THEN event_id WHEN 2 THEN event_id WHEN 3 THEN -event_id
            WHEN 5 THEN 0 END AS as_bigint,
       CAST(CASE event_id % 8 WHEN 0 THEN CAST(trunc(value) AS INTEGER)
            WHEN 1 THEN event_id WHEN 2 THEN event_id WHEN 3 THEN -event_id
            WHEN 5 THEN 0 END AS INTEGER) AS as_int,
       CASE event_id % 8 WHEN 0 THEN value WHEN 1 THEN CAST(event_id AS DOUBLE)
            WHEN 2 THEN CAST(event_id AS DOUBLE)
            WHEN 3 THEN CAST('-' || event_id || '.5' AS DOUBLE)
            WHEN 5 THEN CAST('0.' || event_id AS DOUBLE)
            WHEN 6 THEN CAST(event_id * 100 AS DOUBLE) END AS as_double,
       CASE event_id % 5 WHEN 2 THEN NULL
            WHEN 4 THEN make_date(CAST(year(ts) AS INTEGER), 1, 1)
            ELSE CAST(ts AS DATE) END AS as_date
FROM events
""")
def cast_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, ts = F.col("event_id"), F.col("ts")
    number = (
        F.when(key % 8 == 0, F.col("value").cast("string"))
        .when(key % 8 == 1, F.concat(F.lit(" "), key, F.lit("\t")))
        .when(key % 8 == 2, F.concat(F.lit("+"), key, F.lit(".")))
        .when(key % 8 == 3, F.concat(F.lit("-"), key, F.lit(".5")))
        .when(key % 8 == 4, F.concat(F.lit("x"), key))
        .when(key % 8 == 5, F.concat(F.lit("."), key))
        .when(key % 8 == 6, F.concat(key, F.lit("e2")))
    )
    day = (
        F.when(key % 5 == 0, ts.cast("string"))
        .when(key % 5 == 1, ts.cast("date").cast("string"))
        .when(key % 5 == 2, "05/01/2024")
        .when(key % 5 == 3, F.concat_ws("-", F.year(ts), F.month(ts), F.dayofmonth(ts)))
        .otherwise(F.year(ts).cast("string"))
    )
    events = adapter.table(spark, sf_dir, "events")
    return events.select("event_id", number.alias("n"), day.alias("d")).select(
        "event_id",
        to_bigint(F.col("n")).alias("as_bigint"),
        to_int(F.col("n")).alias("as_int"),
        to_double(F.col("n")).alias("as_double"),
        to_date_lenient(F.col("d")).alias("as_date"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity,
       CASE WHEN l_quantity - 25 > 0 THEN
            CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END / (l_quantity - 25)
            ELSE 0.0 END AS ratio,
       CAST(l_quantity AS INTEGER) * l_extendedprice AS line_amount
FROM lineitem
""")
def safe_ratio_line_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    numerator = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice"))
    return adapter.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "l_quantity",
        safe_ratio(numerator, F.col("l_quantity") - 25).alias("ratio"),
        line_amount(F.col("l_quantity").cast("int"), F.col("l_extendedprice")).alias(
            "line_amount"
        ),
    )


_DATE_PARTS_SQL = ", ".join(
    f"CAST({function}(d) AS INTEGER) AS {name}"
    for name, function in {
        "year": "year", "month": "month", "day": "day", "week": "week", "quarter": "quarter",
    }.items()
)


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, d, {_DATE_PARTS_SQL}
FROM (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem)
""")
def date_parts_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        adapter.table(spark, sf_dir, "lineitem")
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("d")
        )
        .withColumns(date_parts(F.col("d")))
    )


@query("""
SELECT *, 2024 AS ingest_year, 1 AS ingest_month, 31 AS ingest_day
FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders)
""")
def tag_ingest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = adapter.table(spark, sf_dir, "orders")
    return lake.tag_ingest_date(
        orders.select("o_orderkey", "o_custkey", "o_totalprice"), SILVER_PARTITION, DAY_ONE
    )


# Row rules and duplicates.


@query(text.with_bronze(True, "SELECT * FROM b_customers WHERE customer_id IS NOT NULL"))
def require_key_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return require_key(typed(spark, sf_dir, "customers"), "customer_id")


@query(
    text.with_bronze(True, "SELECT * FROM b_order_items WHERE quantity > 0 AND unit_price > 0")
)
def positive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return require_positive(typed(spark, sf_dir, "order_items"), "quantity", "unit_price")


@query(text.with_bronze(True, "SELECT * FROM b_reviews WHERE rating >= 1 AND rating <= 5"))
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return require_between(typed(spark, sf_dir, "product_reviews"), "rating", 1, 5)


@query(text.with_bronze(True, text.first_per_key("b_orders")))
def dedup_by_key_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_by_key(typed(spark, sf_dir, "orders"), "order_id")


_HOT_KEY_SQL = "CASE WHEN l_orderkey % 3 <> 0 THEN l_partkey END"


@query(f"""
SELECT part_key, l_orderkey, l_extendedprice
FROM (SELECT {_HOT_KEY_SQL} AS part_key, l_orderkey, l_extendedprice FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY part_key
                           ORDER BY l_orderkey NULLS FIRST, l_extendedprice NULLS FIRST) = 1
""")
def dedup_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows share one key."""
    key = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_partkey")).alias("part_key")
    items = adapter.table(spark, sf_dir, "lineitem")
    return dedup_by_key(items.select(key, "l_orderkey", "l_extendedprice"), "part_key")


@query("""
SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate
FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey
                           ORDER BY o_orderdate DESC, o_orderkey NULLS FIRST) = 1
""")
def dedup_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = adapter.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date")
    )
    return dedup_by_key(orders, "o_custkey", [F.col("o_orderdate").desc()])


@query(text.with_bronze(True, "SELECT DISTINCT order_date AS date_key FROM b_orders"))
def distinct_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(typed(spark, sf_dir, "orders"), "order_date", "date_key")


# Joins.

_FK_FILTER_SQL = text.with_silver(
    True,
    "SELECT * FROM b_orders WHERE customer_id IN (SELECT customer_id FROM dim_customers)",
)


@query(_FK_FILTER_SQL)
def fk_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = silver.dim_customers(adapter.customers(spark, sf_dir, True), KEY_TYPE)
    return fk_filter(typed(spark, sf_dir, "orders"), customers, "customer_id")


@query(_FK_FILTER_SQL)
def fk_filter_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = silver.dim_customers(adapter.customers(spark, sf_dir, True), KEY_TYPE)
    return fk_filter(typed(spark, sf_dir, "orders"), customers, "customer_id", salt=8)


_FK_ENRICH_SQL = text.with_silver(
    True,
    "SELECT i.*, o.order_date FROM b_order_items i JOIN fact_orders o ON o.order_id = i.order_id",
)


@query(_FK_ENRICH_SQL)
def fk_enrich_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Silver(spark, sf_dir, True).fact_orders
    return fk_enrich(typed(spark, sf_dir, "order_items"), orders, "order_id", "order_date")


@query(_FK_ENRICH_SQL)
def fk_enrich_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Silver(spark, sf_dir, True).fact_orders
    items = typed(spark, sf_dir, "order_items")
    return fk_enrich(items, orders, "order_id", "order_date", salt=8)


_LEFT_ENRICH_SQL = text.with_silver(
    True,
    "SELECT i.*, p.product_name, p.category, p.brand FROM b_order_items i "
    "LEFT JOIN dim_products p ON p.product_id = i.product_id",
)


def _items_with_products(spark: SparkSession, sf_dir: str, salt: int) -> DataFrame:
    products = silver.dim_products(adapter.products(spark, sf_dir, True), KEY_TYPE)
    items = typed(spark, sf_dir, "order_items")
    names = ("product_name", "category", "brand")
    return left_enrich(items, products, "product_id", *names, salt=salt)


@query(_LEFT_ENRICH_SQL)
def left_enrich_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items_with_products(spark, sf_dir, 1)


@query(_LEFT_ENRICH_SQL)
def left_enrich_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items_with_products(spark, sf_dir, 8)


# Aggregates.

_ORDER_TOTALS_SQL = f"""
SELECT customer_id, {text.money("sum(total_amount)")} AS total_amount_sum,
       count(DISTINCT order_id) AS total_orders,
       min(order_date) AS first_order_date, max(order_date) AS last_order_date
FROM b_orders GROUP BY customer_id
"""


@query(text.with_bronze(True, _ORDER_TOTALS_SQL))
def agg_sum_distinct_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order ids repeat and a third of the rows belong to one customer."""
    return rounded(
        order_totals(typed(spark, sf_dir, "orders"), "customer_id", "total_amount_sum")
    )


@query(text.with_bronze(False, _ORDER_TOTALS_SQL))
def agg_sum_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = typed(spark, sf_dir, "orders", dirty=False)
    return rounded(order_totals(orders, "customer_id", "total_amount_sum", unique_ids=True))


@query(
    text.with_bronze(
        True,
        "SELECT product_id, round(avg(rating), 6) AS avg_rating, "
        "count(DISTINCT review_id) AS nb_reviews FROM b_reviews GROUP BY product_id",
    )
)
def agg_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review_stats(typed(spark, sf_dir, "product_reviews")))


_PRODUCT_SALES_SQL = f"""
SELECT product_id, CAST(sum(quantity) AS BIGINT) AS total_quantity_sold,
       {text.money("sum(quantity * unit_price)")} AS total_revenue
FROM b_order_items GROUP BY product_id
"""


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = typed(spark, sf_dir, "order_items")
    amount = line_amount(F.col("quantity"), F.col("unit_price"))
    return product_sales(items.withColumn("line_amount", amount))


@query(text.with_bronze(True, _PRODUCT_SALES_SQL))
def agg_product_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sales(spark, sf_dir))


@query(
    text.with_bronze(
        True,
        "SELECT p.p_partkey AS product_id, p.p_name AS product_name, "
        "coalesce(s.total_quantity_sold, 0) AS total_quantity_sold, "
        "coalesce(s.total_revenue, 0.0) AS total_revenue FROM part p "
        f"LEFT JOIN ({_PRODUCT_SALES_SQL}) s ON s.product_id = p.p_partkey",
    )
)
def fill_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeros for parts that no dirty item names."""
    parts = adapter.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name")
    )
    sales = rounded(_sales(spark, sf_dir))
    return left_enrich(parts, sales, "product_id", "total_quantity_sold", "total_revenue").na.fill(
        {"total_quantity_sold": 0, "total_revenue": 0.0}
    )


# Sources, sinks and jobs, through files in the cluster's shared folder.


@query(text.with_bronze(True, "SELECT * FROM b_orders"))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder whose files have their columns in two orders."""
    path = scratch_path(spark, "csv-orders")
    orders = adapter.orders(spark, sf_dir, True)
    # Rows are told apart by their text alone, so that both parts together have each once.
    first = F.xxhash64(*orders.columns) % 2 == 0
    orders.where(first).write.option("header", True).csv(path)
    turned = orders.where(~first).select(*reversed(orders.columns))
    turned.write.mode("append").option("header", True).csv(path)
    both = read_csv(spark, path, ["order_id"])
    return cast_fields(both, BRONZE["orders"], KEY_TYPE)


_WIDE = 3_000_000_000


@query(
    text.with_bronze(
        False,
        f"SELECT * REPLACE (order_id + {_WIDE} AS order_id, customer_id + {_WIDE} AS customer_id) "
        "FROM b_orders",
    )
)
def wide_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids beyond 2**31 as text, through the silver table with the default type of ids."""

    def raised(df: DataFrame, *names: str) -> DataFrame:
        wide = {n: (F.col(n).cast("bigint") + F.lit(_WIDE)).cast("string") for n in names}
        return df.withColumns(wide)

    customers = silver.dim_customers(raised(adapter.customers(spark, sf_dir), "customer_id"))
    orders = raised(adapter.orders(spark, sf_dir), "order_id", "customer_id")
    return silver.fact_orders(orders, customers)


@query(text.with_bronze(True, "SELECT * FROM b_customers"))
def bronze_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing a day again replaces it, and other days are not read."""
    root = scratch_path(spark, "bronze")
    customers = adapter.customers(spark, sf_dir, True)
    jobs.run_bronze({"customers": adapter.customers(spark, sf_dir)}, root, DAY_TWO)
    jobs.run_bronze({"customers": adapter.customers(spark, sf_dir)}, root, DAY_ONE)
    jobs.run_bronze({"customers": customers}, root, DAY_ONE)
    stored = lake.read_bronze(spark, root, "customers", DAY_ONE)
    return cast_fields(stored, BRONZE["customers"], KEY_TYPE)


def _plus_one(orders: DataFrame) -> DataFrame:
    return orders.withColumn("total_amount", F.col("total_amount") + 1)


def _two_days_of_orders(spark: SparkSession, sf_dir: str) -> str:
    """Day one written twice, then day two with amounts one higher."""
    root = scratch_path(spark, "silver")
    orders = Silver(spark, sf_dir, False).fact_orders
    lake.write_silver(orders, root, "fact_orders", DAY_ONE)
    lake.write_silver(orders, root, "fact_orders", DAY_ONE)
    lake.write_silver(_plus_one(orders), root, "fact_orders", DAY_TWO)
    for day in (DAY_ONE, DAY_TWO):
        lake.complete_day(spark, root, day, ["fact_orders"])
    return root


_DAY_TWO_SQL = """
SELECT customer_id, order_id, order_date, total_amount + 1 AS total_amount,
       payment_method, shipping_country FROM fact_orders
"""
_BOTH_DAYS_SQL = f"SELECT * FROM fact_orders UNION ALL {_DAY_TWO_SQL}"


@query(text.with_silver(False, _DAY_TWO_SQL))
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _two_days_of_orders(spark, sf_dir)
    return lake.read_silver(spark, root, "fact_orders", lake.LATEST, KEY_TYPE)


@query(text.with_silver(False, "SELECT * FROM fact_orders"))
def snapshot_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _two_days_of_orders(spark, sf_dir)
    return lake.read_silver(spark, root, "fact_orders", DAY_ONE, KEY_TYPE)


@query(text.with_silver(False, _BOTH_DAYS_SQL))
def snapshot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _two_days_of_orders(spark, sf_dir)
    return lake.read_silver(spark, root, "fact_orders", lake.ALL, KEY_TYPE)


@query(text.with_silver(False, _BOTH_DAYS_SQL))
def catalog_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table declared over day one shows day two once its partitions are repaired."""
    root, database = scratch_path(spark, "silver"), f"stratacart_{uuid4().hex}"
    orders = Silver(spark, sf_dir, False).fact_orders
    lake.write_silver(orders, root, "fact_orders", DAY_ONE)
    catalog.create_database(spark, database, f"{root}/warehouse")
    catalog.register_table(spark, database, "fact_orders", root, KEY_TYPE)
    catalog.repair_partitions(spark, database, "fact_orders")
    lake.write_silver(_plus_one(orders), root, "fact_orders", DAY_TWO)
    catalog.repair_partitions(spark, database, "fact_orders")
    return catalog.read_table(spark, database, "fact_orders", lake.ALL)


def _copies_sql(name: str) -> str:
    """The datamart over two stored ingest dates with equal content, stated on doubled tables."""
    tables = ("fact_orders", "fact_order_items", "fact_reviews", "dim_products", "dim_customers")
    doubled = ", ".join(
        f"twice_{t} AS (SELECT * FROM {t} UNION ALL SELECT * FROM {t})" for t in tables
    )
    marts = text.GOLD
    for table in tables:
        marts = marts.replace(f"FROM {table}", f"FROM twice_{table}")
        marts = marts.replace(f"JOIN {table}", f"JOIN twice_{table}")
    return text.with_silver(True, f", {doubled}, {marts} SELECT * FROM {name}")


def _summary(tables: Mapping[str, DataFrame], totals: Mapping[str, Column]) -> DataFrame:
    parts = [
        df.agg(
            F.lit(name).alias("table"),
            F.count(F.lit(1)).alias("rows"),
            money(F.sum(totals[name])).alias("total"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# A number per table whose sum tells a wrong row apart.
_TOTALS = {
    "dim_customers": "customer_id",
    "dim_products": "price",
    "dim_date": "week",
    "fact_orders": "total_amount",
    "fact_order_items": "line_amount",
    "fact_reviews": "rating",
    "dm_sales_daily": "total_revenue",
    "dm_sales_by_product": "total_revenue",
    "dm_customer_metrics": "total_spent",
    "dm_product_reviews_impact": "total_revenue",
    "dm_stock_performance": "total_quantity_sold",
}


@query(
    text.with_gold(
        True,
        " UNION ALL ".join(
            f"SELECT '{name}' AS \"table\", count(*) AS rows, "
            f"{text.money(f'sum(CAST({column} AS DOUBLE))')} AS total FROM {name}"
            for name, column in _TOTALS.items()
        ),
    )
)
def job_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and a total of each table that the jobs stored."""
    tables = {name: _job_table(spark, sf_dir, name) for name in [*SILVER, *GOLD]}
    totals = {name: F.col(column).cast("double") for name, column in _TOTALS.items()}
    return _summary(tables, totals)


@lru_cache(maxsize=4)
def _jobs_done(application: str, sf_dir: str) -> tuple[str, str]:
    """CSV files to bronze to silver to catalog to datamarts, each job run twice, once in an
    application: the folder and the database that they filled. A second day has equal content."""
    spark = SparkSession.active()
    root, database = scratch_path(spark, "pipeline"), f"stratacart_{uuid4().hex}"
    catalog.create_database(spark, database, f"{root}/warehouse")
    sources = {}
    for name, make in adapter.BRONZE.items():
        path = f"{root}/landing/{name}"
        packed = make(spark, sf_dir, True).write.options(header=True, compression="gzip")
        packed.csv(path)
        sources[name] = read_csv(spark, path)
    for _ in range(2):
        jobs.run_bronze(sources, f"{root}/bronze", DAY_ONE)
        jobs.run_silver(spark, f"{root}/bronze", f"{root}/silver", DAY_ONE, KEY_TYPE)
        catalog.register_silver(spark, database, f"{root}/silver", KEY_TYPE)
        jobs.run_gold(spark, jobs.parquet_sink(f"{root}/gold"), database=database)
    jobs.run_bronze(sources, f"{root}/bronze", DAY_TWO)
    jobs.run_silver(spark, f"{root}/bronze", f"{root}/silver", DAY_TWO, KEY_TYPE)
    catalog.register_silver(spark, database, f"{root}/silver", KEY_TYPE)
    return root, database


def _job_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    root, database = _jobs_done(spark.sparkContext.applicationId, sf_dir)
    if name in SILVER:
        return catalog.read_table(spark, database, name, DAY_ONE)
    return rounded(jobs.read_gold(spark, f"{root}/gold", name))


def _register_job_tables() -> None:
    """All rows of each table that the jobs stored."""
    for name in [*SILVER, *GOLD]:
        QUERIES[f"job_{name}"] = lambda spark, sf_dir, n=name: _job_table(spark, sf_dir, n)
        SQL[f"job_{name}"] = text.with_gold(True, f"SELECT * FROM {name}")


_register_job_tables()


def _register_copies() -> None:
    def over_all_dates(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
        root, _ = _jobs_done(spark.sparkContext.applicationId, sf_dir)
        inputs = jobs.read_gold_inputs(
            spark, root=f"{root}/silver", snapshot=lake.ALL, key_type=KEY_TYPE
        )
        return rounded(jobs.datamarts(inputs)[name])

    for name in GOLD:
        QUERIES[f"{name}_all_dates"] = lambda spark, sf_dir, n=name: over_all_dates(
            spark, sf_dir, n
        )
        SQL[f"{name}_all_dates"] = _copies_sql(name)


_register_copies()


# What the quality rules let through, counted while the job wrote the tables.

_RULES = {
    "dim_customers": ("b_customers", "customer_id IS NOT NULL"),
    "dim_products": ("b_products", "product_id IS NOT NULL"),
    "fact_orders": ("b_orders", "total_amount > 0"),
    "fact_order_items": ("b_order_items", "quantity > 0 AND unit_price > 0"),
    "fact_reviews": ("b_reviews", "rating BETWEEN 1 AND 5"),
}


def _rule_counts_sql(table: str, source: str, rule: str) -> str:
    kept = f"(SELECT count(*) FROM ({text.first_per_key(source, rule)}))"
    out = f"(SELECT count(*) FROM {table})"
    return (
        f"SELECT '{table}' AS \"table\", count(*) AS rows_in, "
        f"count(*) - count(*) FILTER ({rule}) AS filtered, "
        f"count(*) FILTER ({rule}) - {kept} AS duplicate, {kept} - {out} AS orphan, "
        f"{out} AS rows_out FROM {source}"
    )


@query(
    text.with_silver(
        True, " UNION ALL ".join(_rule_counts_sql(t, *how) for t, how in _RULES.items())
    )
)
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the record of the day says of the tables' rows."""
    root, _ = _jobs_done(spark.sparkContext.applicationId, sf_dir)
    counts = lake.day_record(spark, f"{root}/silver", DAY_ONE).counts
    names = ("in", "filtered", "duplicate", "orphan", "out")
    return spark.createDataFrame(
        [(table, *(counts[table][n] for n in names)) for table in _RULES],
        "`table` string, rows_in long, filtered long, duplicate long, orphan long, rows_out long",
    )


# Days of changes.


def _order(name: str) -> Column:
    return F.col(name).cast("bigint")


@query(
    text.with_silver(
        False,
        "SELECT * REPLACE (total_amount + CASE WHEN order_id % 4 = 1 THEN 1 ELSE 0 END "
        "AS total_amount) FROM fact_orders",
    )
)
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full day without every third order, then a day with these and with raised amounts."""
    root = scratch_path(spark, "changes")
    orders = Silver(spark, sf_dir, False).fact_orders
    raised = orders.withColumn("total_amount", F.col("total_amount") + 1)
    key = F.col("order_id")
    late = orders.where((key % 3 == 0) & (key % 4 != 1))
    lake.write_silver(orders.where(key % 3 != 0), root, "fact_orders", DAY_ONE)
    lake.write_silver(raised.where(key % 4 == 1).union(late), root, "fact_orders", DAY_TWO)
    lake.commit_day(spark, root, DAY_ONE, tables=["fact_orders"], full=True)
    lake.commit_day(spark, root, DAY_TWO, tables=["fact_orders"], full=False)
    return lake.read_silver(spark, root, "fact_orders", lake.AsOf(), KEY_TYPE)


@lru_cache(maxsize=4)
def _changes_done(application: str, sf_dir: str) -> str:
    """Silver of a full day and a day of changes that add up to the clean tables: every third
    order comes on the second day with its items, and every fifth then gets its right amount."""
    spark = SparkSession.active()
    root = scratch_path(spark, "changes")
    tables = {name: make(spark, sf_dir) for name, make in adapter.BRONZE.items()}
    orders, items = tables["orders"], tables["order_items"]
    wrong = F.when(_order("order_id") % 5 == 0, F.lit("0.5")).otherwise(F.col("total_amount"))
    new = _order("order_id") % 3 == 0
    one = tables | {
        "orders": orders.where(~new).withColumn("total_amount", wrong),
        "order_items": items.where(~new),
    }
    two = {name: df.limit(0) for name, df in tables.items()} | {
        "orders": orders.where(new | (_order("order_id") % 5 == 0)),
        "order_items": items.where(new),
    }
    for day, parts, changes in ((DAY_ONE, one, False), (DAY_TWO, two, True)):
        jobs.run_bronze(parts, f"{root}/bronze", day)
        jobs.run_silver(
            spark, f"{root}/bronze", f"{root}/silver", day, KEY_TYPE, changes=changes
        )
    return f"{root}/silver"


def _register_changes() -> None:
    """Silver tables and datamarts as of the day of changes, as one full day gives them."""

    def as_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
        root = _changes_done(spark.sparkContext.applicationId, sf_dir)
        if name in SILVER:
            return lake.read_silver(spark, root, name, lake.AsOf(), KEY_TYPE)
        inputs = jobs.read_gold_inputs(
            spark, root=root, snapshot=lake.AsOf(), key_type=KEY_TYPE
        )
        return rounded(jobs.datamarts(inputs, unique_ids=True)[name])

    for name in ("fact_orders", "fact_order_items", *GOLD):
        QUERIES[f"{name}_as_of"] = lambda spark, sf_dir, n=name: as_of(spark, sf_dir, n)
        SQL[f"{name}_as_of"] = text.with_gold(False, f"SELECT * FROM {name}")


_register_changes()


@query(text.with_silver(False, "SELECT * FROM fact_orders"))
def compacted_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of changes as a full one, through the catalog."""
    source = _changes_done(spark.sparkContext.applicationId, sf_dir)
    root, database = scratch_path(spark, "compacted"), f"stratacart_{uuid4().hex}"
    pinned = lake.pin(spark, source, lake.AsOf())
    for table in SILVER:
        for record in pinned:
            runs = {record.day: record.runs[table]}
            df = lake.read_runs(spark, source, table, runs, KEY_TYPE)
            df = df.select(*columns(SILVER[table]))
            lake.write_silver(df, root, table, record.day, deal=False)
    for record in pinned:
        lake.commit_day(spark, root, record.day, tables=list(SILVER), full=record.full)
    jobs.compact_silver(spark, root, DAY_TWO, KEY_TYPE)
    catalog.create_database(spark, database, f"{root}/warehouse")
    catalog.register_table(spark, database, "fact_orders", root, KEY_TYPE)
    catalog.repair_partitions(spark, database, "fact_orders")
    return catalog.read_table(spark, database, "fact_orders", DAY_TWO)


# The catalog and what is published in it.


@query(text.with_silver(False, _DAY_TWO_SQL))
def catalog_redeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared with int ids over one folder, then with bigint ids over another."""
    database = f"stratacart_{uuid4().hex}"
    orders = Silver(spark, sf_dir, False).fact_orders
    narrow = orders.withColumns({n: F.col(n).cast("int") for n in ("customer_id", "order_id")})
    catalog.create_database(spark, database, scratch_path(spark, "warehouse"))
    for df, kind in ((narrow, "int"), (_plus_one(orders), KEY_TYPE)):
        root = scratch_path(spark, "silver")
        lake.write_silver(df, root, "fact_orders", DAY_ONE)
        catalog.register_table(spark, database, "fact_orders", root, kind)
        catalog.repair_partitions(spark, database, "fact_orders")
    return catalog.read_table(spark, database, "fact_orders", DAY_ONE)


@query(text.with_gold(True, "SELECT * FROM dm_customer_metrics"))
def published_customer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the view that readers of the catalog see, after a second run."""
    _, silver_database = _jobs_done(spark.sparkContext.applicationId, sf_dir)
    database = f"stratacart_{uuid4().hex}"
    catalog.create_database(spark, database, scratch_path(spark, "marts"))
    sink = jobs.table_sink(database)
    for _ in range(2):
        jobs.run_gold(spark, sink, database=silver_database, snapshot=DAY_ONE)
    return rounded(spark.table(f"{database}.dm_customer_metrics"))


@query(text.with_gold(True, "SELECT * FROM dim_products"))
def current_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by its bare name, while its database is the current one."""
    _, database = _jobs_done(spark.sparkContext.applicationId, sf_dir)
    before = spark.catalog.currentDatabase()
    catalog.use_database(spark, database)
    try:
        products = spark.table("dim_products").where(F.col("ingest_day") == DAY_ONE.day)
        return products.select(*columns(SILVER["dim_products"]))
    finally:
        catalog.use_database(spark, before)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales per day from raw orders: cast, filter, dedup, key check, aggregate, ratio."""
    return gold_table(spark, sf_dir, False, "dm_sales_daily")
