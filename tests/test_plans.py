"""The plans the library counts on: what is shuffled, pruned and split."""

from __future__ import annotations

import re

import pytest
from oracles import adapter
from oracles.queries import KEY_TYPE
from pyspark.sql import functions as F

from stratacart.operators.joins import (
    BROADCAST_ROWS,
    bounded,
    fk_enrich,
    fk_filter,
    left_enrich,
)
from stratacart.plans import gold, silver
from stratacart.schemas import GOLD_INPUTS, SILVER, ddl


@pytest.fixture
def split_small(with_conf):
    """Sizes scaled down so that test data is large: no broadcast, skew from a few kB."""
    return with_conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2000",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="2000",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__files__maxPartitionBytes="20000",
    )


def skewed(session, tmp_path, hot):
    """Children of which a third have one key, over enough files for a split to act on."""
    key = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id") % 4000)
    path = str(tmp_path / "children")
    session.range(0, 60000, 1, 12).select("id", key.alias("k")).write.parquet(path)
    return session.read.parquet(path)


@pytest.mark.parametrize("join", ["filter", "enrich", "left"])
def test_hot_foreign_key_is_split(split_small, executed_plan, tmp_path, join):
    child = skewed(split_small, tmp_path, 7)
    parent = split_small.range(0, 3000, 1, 4).select(
        F.col("id").alias("k"), (F.col("id") * 2).alias("twice")
    )
    if join == "filter":
        joined, kind = fk_filter(child, parent, "k"), "LeftSemi"
    elif join == "enrich":
        joined, kind = fk_enrich(child, parent, "k", "twice"), "Inner"
    else:
        joined, kind = left_enrich(child, parent, "k", "twice"), "LeftOuter"
    plan = executed_plan(joined)
    assert re.search(rf"SortMergeJoin\(skew=true\)[^\n]*{kind}", plan)


@pytest.mark.parametrize("join", [fk_filter, fk_enrich, left_enrich])
def test_copies_of_a_parent_are_not_broadcast(spark, executed_plan, join):
    """Spark takes the parent for as small as one copy of it."""
    child = spark.range(0, 5000).select("id", (F.col("id") % 400).alias("k"))
    parent = spark.range(0, 300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    names = () if join is fk_filter else ("twice",)
    salted = join(child, parent, "k", *names, salt=8)
    assert "Broadcast" not in executed_plan(salted)
    plain = join(child, parent, "k", *names, salt=None)
    assert sorted(salted.collect(), key=str) == sorted(plain.collect(), key=str)


@pytest.mark.parametrize("join", [fk_filter, fk_enrich, left_enrich])
def test_a_bounded_parent_is_broadcast_only_if_known_to_be_small(spark, executed_plan, join):
    child = spark.range(0, 5000).select("id", (F.col("id") % 400).alias("k"))
    parent = spark.range(0, 300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    names = () if join is fk_filter else ("twice",)
    plans = [
        executed_plan(join(child, bounded(parent, rows), "k", *names))
        for rows in (BROADCAST_ROWS, BROADCAST_ROWS + 1, None)
    ]
    assert ["Broadcast" in plan for plan in plans] == [True, False, False]


def test_hot_customer_is_split_in_fact_orders(split_small, executed_plan):
    """Also where the parent comes straight from its deduplication, laid out by the key."""
    sf_dir = "/root/testdata/sf0.01"
    customers = silver.dim_customers(adapter.customers(split_small, sf_dir, True), KEY_TYPE)
    orders = adapter.orders(split_small, sf_dir, True).repartition(8)
    plan = executed_plan(silver.fact_orders(orders, customers, KEY_TYPE))
    assert "SortMergeJoin(skew=true)" in plan


def test_orders_are_not_broadcast_to_their_items(spark, executed_plan, sf_dir):
    tables = {t: adapter.BRONZE[t](spark, sf_dir) for t in ("orders", "products", "customers")}
    orders = silver.fact_orders(tables["orders"], silver.dim_customers(tables["customers"]))
    items = silver.fact_order_items(
        adapter.order_items(spark, sf_dir), orders, silver.dim_products(tables["products"])
    )
    assert executed_plan(items).partition("Initial Plan")[0].count("SortMergeJoin") == 1


@pytest.fixture
def tables(with_conf, tmp_path):
    """Empty silver tables on disk, planned without broadcast."""
    session = with_conf(
        spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"
    )
    for name in GOLD_INPUTS:
        schema = ddl(SILVER[name])
        session.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    return {
        name: session.read.schema(ddl(SILVER[name])).parquet(str(tmp_path / name))
        for name in GOLD_INPUTS
    }


def exchanges(plan):
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)


def keys_of(plan):
    return sorted(re.sub(r"#\d+L?", "", e) for e in exchanges(plan))


def test_sales_by_product_shuffles_partial_sums_only(tables, executed_plan):
    plan = executed_plan(
        gold.dm_sales_by_product(tables["fact_order_items"], tables["dim_products"])
    )
    # One shuffle of per-task sums, one of the dimension, none for the last grouping.
    assert keys_of(plan) == ["product_id", "product_id"]
    assert plan.count("partial_sum(quantity") == 1


def test_customer_metrics_shuffles(tables, executed_plan):
    args = tables["fact_orders"], tables["dim_customers"]
    exact = executed_plan(gold.dm_customer_metrics(*args))
    assert keys_of(exact) == ["customer_id", "customer_id", "customer_id, order_id"]
    unique = executed_plan(gold.dm_customer_metrics(*args, unique_ids=True))
    assert keys_of(unique) == ["customer_id", "customer_id"]


def test_sales_daily_shuffles(tables, executed_plan):
    orders = tables["fact_orders"]
    assert keys_of(executed_plan(gold.dm_sales_daily(orders, unique_ids=True))) == ["date"]
    assert keys_of(executed_plan(gold.dm_sales_daily(orders))) == ["date", "date, order_id"]


def read_columns(df, table):
    """The columns each scan of ``table`` reads."""
    df.collect()
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    scans = re.findall(r"Location: \S+ \[(\S+?)\][\s\S]*?ReadSchema: struct<([^\n]*)>", text)
    return [re.findall(r"(\w+):", cols) for path, cols in scans if path.endswith(table)]


def test_datamarts_read_only_their_columns(tables):
    daily = gold.dm_sales_daily(tables["fact_orders"])
    assert read_columns(daily, "fact_orders") == [["order_id", "order_date", "total_amount"]]
    stock = gold.dm_stock_performance(tables["dim_products"], tables["fact_order_items"])
    assert read_columns(stock, "fact_order_items") == [["product_id", "quantity"]]


def test_reviews_impact_joins_on_one_partitioning(tables, executed_plan):
    plan = executed_plan(
        gold.dm_product_reviews_impact(
            tables["dim_products"], tables["fact_reviews"], tables["fact_order_items"]
        )
    )
    assert keys_of(plan) == ["product_id"] * 3 + ["product_id, review_id"]


def test_no_python_in_the_plans(split_small, executed_plan, sf_dir):
    customers = silver.dim_customers(adapter.customers(split_small, sf_dir), KEY_TYPE)
    plan = executed_plan(silver.fact_orders(adapter.orders(split_small, sf_dir), customers))
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
