"""The test tables as raw commerce tables.

Clean tables keep the types of the Parquet files, as a database source would bring them.
``dirty`` ones are strings as in a CSV file and hold what the quality rules exist for:
unreadable keys, numbers and dates, amounts out of range, conflicting copies, missing
parents, and foreign keys a third of whose rows hold one value. ``sql.py`` states the
same data as typed SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _text(column: Column) -> Column:
    return column.cast("string")


def _every(column: Column, modulus: int, rest: int) -> Column:
    return column % modulus == rest


def _with_copies(df: DataFrame, key: Column) -> DataFrame:
    """Rows of every fifth key a second time; ``copy`` numbers them."""
    numbers = F.when(_every(key, 5, 0), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    return df.withColumn("copy", F.explode(numbers))


def customers(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    key = F.col("c_custkey")
    nations = table(spark, sf_dir, "nation")
    joined = table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    signup = F.date_add(F.lit("1995-01-01").cast("date"), (key % 2000).cast("int"))
    if not dirty:
        return joined.select(
            key.alias("customer_id"),
            F.col("c_mktsegment").alias("gender"),
            F.col("n_name").alias("country"),
            signup.alias("signup_date"),
        )
    return _with_copies(joined, key).select(
        F.when(_every(key, 97, 5) | _every(key, 7, 2), "n/a")
        .when(_every(key, 19, 3), F.concat(F.lit(" "), key, F.lit(".7 ")))
        .otherwise(_text(key))
        .alias("customer_id"),
        F.col("c_mktsegment").alias("gender"),
        F.when(F.col("copy") == 1, F.concat(F.lit("A_"), "n_name"))
        .when(~_every(key, 29, 6), F.col("n_name"))
        .alias("country"),
        F.when(_every(key, 23, 4), "2024-13-01").otherwise(_text(signup)).alias("signup_date"),
    )


def products(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    names = (
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
    )
    if not dirty:
        return parts.select(
            key.alias("product_id"),
            *names,
            F.col("p_retailprice").alias("price"),
            (F.col("p_size") - 1).alias("stock_quantity"),
        )
    return _with_copies(parts, key).select(
        F.when(_every(key, 97, 5) | _every(key, 7, 2), "n/a")
        .when(_every(key, 19, 3), F.concat(key, F.lit(".")))
        .otherwise(_text(key))
        .alias("product_id"),
        *names,
        F.when(_every(key, 41, 8), "abc")
        .otherwise(_text(F.col("p_retailprice") + F.col("copy")))
        .alias("price"),
        F.when(_every(key, 31, 7), "none")
        .otherwise(_text(F.col("p_size") - 1 + F.col("copy")))
        .alias("stock_quantity"),
    )


def orders(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    key = F.col("o_orderkey")
    source = table(spark, sf_dir, "orders")
    labels = (
        F.col("o_orderpriority").alias("payment_method"),
        F.col("o_orderstatus").alias("shipping_country"),
    )
    if not dirty:
        return source.select(
            key.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("o_totalprice").alias("total_amount"),
            *labels,
        )
    amount = F.col("o_totalprice")
    return _with_copies(source, key).select(
        F.when(_every(key, 103, 9), "n/a")
        .when(_every(key, 19, 3), F.concat(F.lit("+"), key, F.lit(".25")))
        .otherwise(_text(key))
        .alias("order_id"),
        F.when(_every(key, 3, 1), "1").otherwise(_text(F.col("o_custkey"))).alias("customer_id"),
        F.when(_every(key, 101, 7), "unknown")
        .when(_every(key, 2, 0), _text(F.col("o_orderdate").cast("date")))
        .otherwise(_text(F.col("o_orderdate")))
        .alias("order_date"),
        F.when(F.col("copy") == 1, _text(amount + 1))
        .when(_every(key, 17, 6), "")
        .when(_every(key, 11, 3), _text(-amount))
        .otherwise(_text(amount))
        .alias("total_amount"),
        *labels,
    )


def item_id() -> Column:
    """A number for each lineitem row: (l_orderkey, l_linenumber) repeats in the test
    tables, so a checksum of the row's other numbers goes into the lower digits."""
    checksum = (
        F.col("l_partkey") * 7919
        + F.col("l_suppkey") * 104729
        + F.floor(F.col("l_extendedprice") * 100 + 0.5) * 31
        + F.col("l_quantity").cast("bigint") * 1299709
    ) % 1048573
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + checksum


def order_items(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    source = table(spark, sf_dir, "lineitem").withColumn("id", item_id())
    key, order = F.col("id"), F.col("l_orderkey")
    quantity = F.col("l_quantity").cast("int")
    if not dirty:
        return source.select(
            key.alias("order_item_id"),
            order.alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            quantity.alias("quantity"),
            F.col("l_extendedprice").alias("unit_price"),
        )
    part = F.col("l_partkey")
    return _with_copies(source, key).select(
        F.when(_every(key, 89, 11), "n/a").otherwise(_text(key)).alias("order_item_id"),
        _text(order).alias("order_id"),
        F.when(_every(order, 3, 0) | _every(part, 10, 9), "1")
        .otherwise(_text(part))
        .alias("product_id"),
        F.when(_every(order, 13, 4), "0")
        .when(_every(order, 13, 5), F.concat(quantity, F.lit(".9")))
        .otherwise(_text(quantity))
        .alias("quantity"),
        (F.col("l_extendedprice") + F.col("copy")).alias("unit_price"),
    )


def product_reviews(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    key = F.col("event_id")
    events = table(spark, sf_dir, "events")
    product = F.get_json_object("props", "$.k")
    if not dirty:
        return events.select(
            key.alias("review_id"),
            product.alias("product_id"),
            F.col("user_id").alias("customer_id"),
            F.col("value").alias("rating"),
            F.col("ts").alias("review_date"),
        )
    return _with_copies(events, key).select(
        F.when(_every(key, 97, 5), "").otherwise(_text(key)).alias("review_id"),
        F.when(F.col("copy") == 1, "0").otherwise(product).alias("product_id"),
        F.when(_every(key, 4, 1), "x").otherwise(_text(F.col("user_id"))).alias("customer_id"),
        _text(F.col("value")).alias("rating"),
        F.when(_every(key, 9, 2), "31/12/2024")
        .otherwise(_text(F.col("ts")))
        .alias("review_date"),
    )


BRONZE = {
    "customers": customers,
    "products": products,
    "orders": orders,
    "order_items": order_items,
    "product_reviews": product_reviews,
}
