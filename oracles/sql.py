"""The expected results as SQL for the same Parquet tables.

``with_silver`` and ``with_gold`` open a query with the tables it builds on; the raw
tables (``b_*``) are stated with the values that reading the strings must give.
"""

from __future__ import annotations

CLEAN_BRONZE = """
b_customers AS (
  SELECT c_custkey AS customer_id, c_mktsegment AS gender, n_name AS country,
         CAST(DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS DATE) AS signup_date
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
b_products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         p_brand AS brand, p_retailprice AS price, p_size - 1 AS stock_quantity
  FROM part),
b_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CAST(o_orderdate AS DATE) AS order_date, o_totalprice AS total_amount,
         o_orderpriority AS payment_method, o_orderstatus AS shipping_country
  FROM orders),
numbered_items AS (
  SELECT *, (l_orderkey * 8 + l_linenumber) * 1048576
         + (l_partkey * 7919 + l_suppkey * 104729
            + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * 31
            + CAST(l_quantity AS BIGINT) * 1299709) % 1048573 AS id
  FROM lineitem),
b_order_items AS (
  SELECT id AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS unit_price
  FROM numbered_items),
b_reviews AS (
  SELECT event_id AS review_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
         user_id AS customer_id, CAST(trunc(value) AS INTEGER) AS rating,
         CAST(ts AS DATE) AS review_date
  FROM events)
"""

DIRTY_BRONZE = """
copies AS (SELECT unnest([0, 1]) AS copy),
b_customers AS (
  SELECT CASE WHEN c_custkey % 97 <> 5 AND c_custkey % 7 <> 2 THEN c_custkey END AS customer_id,
         c_mktsegment AS gender,
         CASE WHEN copy = 1 THEN 'A_' || n_name
              WHEN c_custkey % 29 <> 6 THEN n_name END AS country,
         CASE WHEN c_custkey % 23 <> 4 THEN
              CAST(DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS DATE)
         END AS signup_date
  FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN copies ON copy = 0 OR c_custkey % 5 = 0),
b_products AS (
  SELECT CASE WHEN p_partkey % 97 <> 5 AND p_partkey % 7 <> 2 THEN p_partkey END AS product_id,
         p_name AS product_name, p_type AS category, p_brand AS brand,
         CASE WHEN p_partkey % 41 <> 8 THEN p_retailprice + copy END AS price,
         CASE WHEN p_partkey % 31 <> 7 THEN p_size - 1 + copy END AS stock_quantity
  FROM part JOIN copies ON copy = 0 OR p_partkey % 5 = 0),
b_orders AS (
  SELECT CASE WHEN o_orderkey % 103 <> 9 THEN o_orderkey END AS order_id,
         CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE o_custkey END AS customer_id,
         CASE WHEN o_orderkey % 101 <> 7 THEN CAST(o_orderdate AS DATE) END AS order_date,
         CASE WHEN copy = 1 THEN o_totalprice + 1
              WHEN o_orderkey % 17 = 6 THEN NULL
              WHEN o_orderkey % 11 = 3 THEN -o_totalprice
              ELSE o_totalprice END AS total_amount,
         o_orderpriority AS payment_method, o_orderstatus AS shipping_country
  FROM orders JOIN copies ON copy = 0 OR o_orderkey % 5 = 0),
numbered_items AS (
  SELECT *, (l_orderkey * 8 + l_linenumber) * 1048576
         + (l_partkey * 7919 + l_suppkey * 104729
            + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * 31
            + CAST(l_quantity AS BIGINT) * 1299709) % 1048573 AS id
  FROM lineitem),
b_order_items AS (
  SELECT CASE WHEN id % 89 <> 11 THEN id END AS order_item_id,
         l_orderkey AS order_id,
         CASE WHEN l_orderkey % 3 = 0 OR l_partkey % 10 = 9 THEN 1 ELSE l_partkey END
           AS product_id,
         CASE WHEN l_orderkey % 13 = 4 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS quantity,
         l_extendedprice + copy AS unit_price
  FROM numbered_items JOIN copies ON copy = 0 OR id % 5 = 0),
b_reviews AS (
  SELECT CASE WHEN event_id % 97 <> 5 THEN event_id END AS review_id,
         CASE WHEN copy = 1 THEN 0
              ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS product_id,
         CASE WHEN event_id % 4 <> 1 THEN user_id END AS customer_id,
         CAST(trunc(value) AS INTEGER) AS rating,
         CASE WHEN event_id % 9 <> 2 THEN CAST(ts AS DATE) END AS review_date
  FROM events JOIN copies ON copy = 0 OR event_id % 5 = 0)
"""

_FIELDS = {
    "b_customers": ("customer_id", "gender", "country", "signup_date"),
    "b_products": (
        "product_id", "product_name", "category", "brand", "price", "stock_quantity",
    ),
    "b_orders": (
        "order_id", "customer_id", "order_date", "total_amount", "payment_method",
        "shipping_country",
    ),
    "b_order_items": ("order_item_id", "order_id", "product_id", "quantity", "unit_price"),
    "b_reviews": ("review_id", "product_id", "customer_id", "rating", "review_date"),
}


def first_per_key(source: str, condition: str = "TRUE") -> str:
    """One row per key, the first column: the smallest by all others, NULLs first."""
    key, *rest = _FIELDS[source]
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in rest)
    return (
        f"SELECT {', '.join(_FIELDS[source])} FROM {source} WHERE {condition} "
        f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"
    )


SILVER = f"""
dim_customers AS ({first_per_key("b_customers", "customer_id IS NOT NULL")}),
dim_products AS ({first_per_key("b_products", "product_id IS NOT NULL")}),
fact_orders AS (
  SELECT customer_id, order_id, order_date, total_amount, payment_method, shipping_country
  FROM ({first_per_key("b_orders", "total_amount > 0")})
  WHERE customer_id IN (SELECT customer_id FROM dim_customers)),
fact_order_items AS (
  SELECT i.product_id, i.order_id, i.order_item_id, i.quantity, i.unit_price,
         o.order_date, i.quantity * i.unit_price AS line_amount
  FROM ({first_per_key("b_order_items", "quantity > 0 AND unit_price > 0")}) i
  JOIN fact_orders o ON o.order_id = i.order_id
  WHERE i.product_id IN (SELECT product_id FROM dim_products)),
fact_reviews AS (
  SELECT customer_id, product_id, review_id, rating, review_date
  FROM ({first_per_key("b_reviews", "rating BETWEEN 1 AND 5")})
  WHERE product_id IN (SELECT product_id FROM dim_products)
    AND customer_id IN (SELECT customer_id FROM dim_customers)),
dim_date AS (
  SELECT DISTINCT order_date AS date_key,
         CAST(year(order_date) AS INTEGER) AS year,
         CAST(month(order_date) AS INTEGER) AS month,
         CAST(day(order_date) AS INTEGER) AS day,
         CAST(week(order_date) AS INTEGER) AS week,
         CAST(quarter(order_date) AS INTEGER) AS quarter
  FROM fact_orders)
"""


def money(total: str) -> str:
    """A sum of amounts in cents, rounded to these, so that the order of adding does not show."""
    return f"round({total}, 2)"


def average_order(total: str) -> str:
    orders = "count(DISTINCT order_id)"
    average = f"CASE WHEN {orders} > 0 THEN {total} / {orders} ELSE 0.0 END"
    return f"CAST(printf('%.11e', {average}) AS DOUBLE)"


GOLD = f"""
dm_sales_daily AS (
  SELECT order_date AS date, {money("sum(total_amount)")} AS total_revenue,
         count(DISTINCT order_id) AS total_orders,
         {average_order("sum(total_amount)")} AS avg_order_value
  FROM fact_orders GROUP BY order_date),
dm_sales_by_product AS (
  SELECT i.product_id, p.product_name, p.category, p.brand,
         CAST(sum(i.quantity) AS BIGINT) AS total_quantity_sold,
         {money("sum(i.line_amount)")} AS total_revenue
  FROM fact_order_items i LEFT JOIN dim_products p ON p.product_id = i.product_id
  GROUP BY i.product_id, p.product_name, p.category, p.brand),
dm_customer_metrics AS (
  SELECT o.customer_id, c.country, count(DISTINCT o.order_id) AS total_orders,
         {money("sum(o.total_amount)")} AS total_spent,
         min(o.order_date) AS first_order_date, max(o.order_date) AS last_order_date,
         {average_order("sum(o.total_amount)")} AS avg_order_value
  FROM fact_orders o LEFT JOIN dim_customers c ON c.customer_id = o.customer_id
  GROUP BY o.customer_id, c.country),
dm_product_reviews_impact AS (
  SELECT p.product_id, p.product_name,
         round(coalesce(r.avg_rating, 0.0), 6) AS avg_rating,
         coalesce(r.nb_reviews, 0) AS nb_reviews,
         {money("coalesce(s.total_revenue, 0.0)")} AS total_revenue
  FROM dim_products p
  LEFT JOIN (SELECT product_id, avg(rating) AS avg_rating,
                    count(DISTINCT review_id) AS nb_reviews
             FROM fact_reviews GROUP BY product_id) r ON r.product_id = p.product_id
  LEFT JOIN (SELECT product_id, sum(line_amount) AS total_revenue
             FROM fact_order_items GROUP BY product_id) s ON s.product_id = p.product_id),
dm_stock_performance AS (
  SELECT p.product_id, p.product_name, p.category, p.stock_quantity,
         CAST(coalesce(s.sold, 0) AS BIGINT) AS total_quantity_sold,
         round(CASE WHEN p.stock_quantity > 0
               THEN coalesce(s.sold, 0) / p.stock_quantity ELSE 0.0 END, 6)
           AS stock_turnover_ratio
  FROM dim_products p
  LEFT JOIN (SELECT product_id, sum(quantity) AS sold
             FROM fact_order_items GROUP BY product_id) s ON s.product_id = p.product_id)
"""


def with_bronze(dirty: bool, final: str) -> str:
    return f"WITH {DIRTY_BRONZE if dirty else CLEAN_BRONZE} {final}"


def with_silver(dirty: bool, final: str) -> str:
    return with_bronze(dirty, f", {SILVER} {final}")


def with_gold(dirty: bool, final: str) -> str:
    return with_silver(dirty, f", {GOLD} {final}")
