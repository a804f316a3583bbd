from __future__ import annotations

import logging
import shutil
import subprocess
import sys
import threading
import time
from datetime import date
from pathlib import Path

import duckdb
import pytest
from conftest import DAY, NEXT_DAY
from oracles import adapter
from pyspark.sql import functions as F

from stratacart.operators.counts import RowCounts
from stratacart.plans import jobs, silver
from stratacart.schemas import GOLD, SILVER
from stratacart.session import open_session, shuffle_partitions_for, skew_is_split
from stratacart.sources import catalog, files, lake
from stratacart.sources.landing import run_in_transaction
from stratacart.sources.scratch import discard, materialize, scratch_path, scratch_root


@pytest.fixture(scope="module")
def lakehouse(spark, tmp_path_factory):
    """Bronze, silver and the catalog after two runs of the same day."""
    root = str(tmp_path_factory.mktemp("lakehouse"))
    sources = {
        name: make(spark, "/root/testdata/sf0.001", True)
        for name, make in adapter.BRONZE.items()
    }
    for _ in range(2):
        jobs.run_bronze(sources, f"{root}/bronze", DAY)
        jobs.run_silver(spark, f"{root}/bronze", f"{root}/silver", DAY, "bigint")
        catalog.register_silver(spark, "lakehouse", f"{root}/silver", "bigint")
    yield root
    spark.sql("DROP DATABASE lakehouse CASCADE")


def rows(df):
    rounded = df.select(
        *(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)
    )
    return sorted(map(str, rounded.collect()))


def test_second_run_leaves_one_copy(spark, lakehouse):
    for table in SILVER:
        df = lake.read_silver(spark, f"{lakehouse}/silver", table, lake.ALL, "bigint")
        assert df.count() == df.distinct().count() > 0, table


def collect_sink(results):
    def sink(df, table):
        results[table] = rows(df)

    return sink


def test_gold_from_folders_equals_gold_from_catalog(spark, lakehouse):
    by_folder, by_catalog, by_day, over_all = {}, {}, {}, {}
    silver_root = f"{lakehouse}/silver"
    jobs.run_gold(spark, collect_sink(by_folder), root=silver_root, key_type="bigint")
    jobs.run_gold(spark, collect_sink(by_catalog), database="lakehouse")
    jobs.run_gold(
        spark, collect_sink(by_day), database="lakehouse", snapshot=DAY, unique_ids=True
    )
    jobs.run_gold(
        spark, collect_sink(over_all), root=silver_root, snapshot=lake.ALL, key_type="bigint"
    )
    assert set(by_folder) == set(GOLD)
    assert by_folder == by_catalog == by_day == over_all


def test_sinks(spark, lakehouse, tmp_path):
    jobs.run_gold(spark, jobs.parquet_sink(str(tmp_path)), database="lakehouse")
    spark.sql("CREATE DATABASE IF NOT EXISTS marts_test")
    jobs.run_gold(spark, jobs.table_sink("marts_test"), database="lakehouse")
    for table in GOLD:
        stored = jobs.read_gold(spark, str(tmp_path), table)
        assert rows(stored) == rows(spark.table(f"marts_test.{table}"))
    spark.sql("DROP DATABASE marts_test CASCADE")


@pytest.fixture
def marts_database(spark):
    spark.sql("CREATE DATABASE marts_switch")
    yield "marts_switch"
    spark.sql("DROP DATABASE marts_switch CASCADE")


class Broken(jobs.TableSink):
    """Fails at one datamart, with one row in the others."""

    def __call__(self, df, table):
        if table == "dm_stock_performance":
            raise RuntimeError("no room")
        super().__call__(df.limit(1), table)


def shown(spark, database):
    return {t: rows(spark.table(f"{database}.{t}")) for t in GOLD}


def run_tables(spark, database):
    return sorted(t.name for t in spark.catalog.listTables(database) if "__" in t.name)


def test_tables_are_published_together(spark, lakehouse, marts_database):
    sink = jobs.table_sink(marts_database)
    jobs.run_gold(spark, sink, database="lakehouse")
    first, tables = shown(spark, marts_database), run_tables(spark, marts_database)
    assert len(tables) == len(GOLD)
    with pytest.raises(RuntimeError, match="no room"):
        jobs.run_gold(spark, Broken(marts_database), database="lakehouse")
    assert shown(spark, marts_database) == first
    assert run_tables(spark, marts_database) == tables
    for _ in range(2):
        jobs.run_gold(spark, sink, database="lakehouse")
        assert shown(spark, marts_database) == first
        assert len(run_tables(spark, marts_database)) == 2 * len(GOLD)


def test_a_switch_that_fails_is_turned_back(spark, lakehouse, marts_database, monkeypatch):
    jobs.run_gold(spark, jobs.table_sink(marts_database), database="lakehouse")
    first = shown(spark, marts_database)

    class Stuck(jobs.TableSink):
        turns = 0

        def __call__(self, df, table):
            super().__call__(df.limit(1), table)

        def _turn(self, spark, table, run):
            self.turns += run == self.run
            if self.turns == 4 and run == self.run:
                raise RuntimeError("catalog is away")
            super()._turn(spark, table, run)

    with pytest.raises(RuntimeError, match="away"):
        jobs.run_gold(spark, Stuck(marts_database), database="lakehouse")
    assert shown(spark, marts_database) == first


def test_a_table_of_the_same_name_is_kept(spark, lakehouse, marts_database):
    spark.range(3).write.saveAsTable(f"{marts_database}.dm_sales_daily")
    jobs.run_gold(spark, jobs.table_sink(marts_database), database="lakehouse")
    assert "date" in spark.table(f"{marts_database}.dm_sales_daily").columns
    kept = [n for n in run_tables(spark, marts_database) if "0before" in n]
    assert [spark.table(f"{marts_database}.{n}").count() for n in kept] == [3]


def test_gold_of_no_run_is_named(spark, tmp_path):
    with pytest.raises(ValueError, match="no run of the datamarts"):
        jobs.read_gold(spark, str(tmp_path), "dm_sales_daily")


def test_intermediate_is_discarded(spark, lakehouse):
    base = spark.conf.get("spark.checkpoint.dir")
    before = files.child_folders(spark, base)
    jobs.run_gold(spark, lambda df, table: None, database="lakehouse")
    assert files.child_folders(spark, base) == before


def test_gold_arguments(spark, lakehouse):
    with pytest.raises(ValueError, match="either"):
        jobs.run_gold(spark, collect_sink({}))
    with pytest.raises(ValueError, match="unique_ids"):
        jobs.run_gold(
            spark, collect_sink({}), database="lakehouse", snapshot=lake.ALL, unique_ids=True
        )


def test_failure_is_logged_and_raised(spark, tmp_path, caplog):
    with caplog.at_level(logging.INFO), pytest.raises(Exception, match="(?i)path"):
        jobs.run_silver(spark, str(tmp_path), str(tmp_path), NEXT_DAY)
    assert "silver failed" in caplog.text and "silver done" not in caplog.text


def test_sink_failure_is_raised(spark, lakehouse):
    def sink(df, table):
        raise RuntimeError("no room")

    with pytest.raises(RuntimeError, match="no room"):
        jobs.run_gold(spark, sink, database="lakehouse")


def test_a_failed_run_publishes_nothing(spark, lakehouse, tmp_path):
    sink = jobs.parquet_sink(str(tmp_path))
    jobs.run_gold(spark, sink, database="lakehouse")
    before = rows(jobs.read_gold(spark, str(tmp_path), "dm_sales_daily"))

    class Failing(jobs.ParquetSink):
        def __call__(self, df, table):
            if table == "dm_stock_performance":
                raise RuntimeError("no room")
            super().__call__(df.limit(1), table)

    with pytest.raises(RuntimeError, match="no room"):
        jobs.run_gold(spark, Failing(str(tmp_path)), database="lakehouse")
    assert rows(jobs.read_gold(spark, str(tmp_path), "dm_sales_daily")) == before


@pytest.fixture
def two_days(spark, lakehouse, tmp_path):
    """Bronze and silver of two days with equal content."""
    for day in (DAY, NEXT_DAY):
        jobs.run_bronze(
            {t: lake.read_bronze(spark, f"{lakehouse}/bronze", t, DAY) for t in adapter.BRONZE},
            str(tmp_path / "bronze"),
            day,
        )
        jobs.run_silver(spark, str(tmp_path / "bronze"), str(tmp_path / "silver"), day)
    return str(tmp_path / "bronze"), str(tmp_path / "silver")


def folders(root, day):
    year, month, day_no = day.year, day.month, day.day
    leaf = f"ingest_year={year}/ingest_month={month}/ingest_day={day_no}"
    return {t: sorted(p.name for p in Path(root, t, leaf).iterdir()) for t in SILVER}


def test_a_failing_rerun_leaves_its_day(spark, two_days, monkeypatch):
    bronze, root = two_days
    before, there = lake.day_record(spark, root, NEXT_DAY), folders(root, NEXT_DAY)
    assert before.unique_ids and set(before.runs) == set(SILVER)

    def broken(*_, **__):
        raise RuntimeError("stopped")

    monkeypatch.setattr(jobs.silver, "fact_order_items", broken)
    with pytest.raises(RuntimeError, match="stopped"):
        jobs.run_silver(spark, bronze, root, NEXT_DAY)
    assert lake.day_record(spark, root, NEXT_DAY) == before
    assert lake.latest_snapshot(spark, root) == NEXT_DAY
    assert folders(root, NEXT_DAY) == there


def test_readers_see_one_run_before_during_and_after(spark, two_days, monkeypatch):
    """All six tables change by one record, and the run before can still be read."""
    bronze, root = two_days
    old = {t: lake.read_silver(spark, root, t, NEXT_DAY) for t in SILVER}
    sizes = {t: df.count() for t, df in old.items()}
    few = {t: lake.read_bronze(spark, bronze, t, DAY).limit(60) for t in adapter.BRONZE}
    jobs.run_bronze(few, bronze, NEXT_DAY)
    during, commit = [], lake.commit_day

    def watched(*args, **kwargs):
        during.append({t: lake.read_silver(spark, root, t, NEXT_DAY).count() for t in SILVER})
        commit(*args, **kwargs)
        during.append({t: lake.read_silver(spark, root, t, NEXT_DAY).count() for t in SILVER})

    monkeypatch.setattr(lake, "commit_day", watched)
    jobs.run_silver(spark, bronze, root, NEXT_DAY)
    assert during[0] == sizes and during[1] != sizes
    assert during[1]["dim_customers"] <= 60 < sizes["dim_customers"]
    assert {t: df.count() for t, df in old.items()} == sizes
    assert all(len(runs) == 2 for runs in folders(root, NEXT_DAY).values())
    jobs.run_silver(spark, bronze, root, NEXT_DAY)
    assert all(len(runs) == 2 for runs in folders(root, NEXT_DAY).values())


def test_gold_reads_one_run_whatever_is_committed_meanwhile(spark, two_days):
    bronze, root = two_days
    inputs = jobs.read_gold_inputs(spark, root=root)
    sizes = {t: df.count() for t, df in inputs.items()}
    jobs.run_bronze(
        {t: lake.read_bronze(spark, bronze, t, DAY).limit(10) for t in adapter.BRONZE},
        bronze,
        NEXT_DAY,
    )
    jobs.run_silver(spark, bronze, root, NEXT_DAY)
    assert {t: df.count() for t, df in inputs.items()} == sizes


def test_counts_of_the_rules_add_up(spark, two_days):
    bronze, root = two_days
    counts = lake.day_record(spark, root, NEXT_DAY).counts
    for table, source in (
        ("dim_customers", "customers"), ("dim_products", "products"), ("fact_orders", "orders"),
        ("fact_order_items", "order_items"), ("fact_reviews", "product_reviews"),
    ):
        found = counts[table]
        assert found["in"] == lake.read_bronze(spark, bronze, source, DAY).count()
        assert found["out"] == lake.read_silver(spark, root, table, DAY).count()
        lost = found["filtered"] + found["duplicate"] + found["orphan"]
        assert found["in"] - lost == found["out"] and min(found.values()) >= 0
    assert counts["fact_orders"]["bad_order_id"] > 0
    assert counts["dim_date"] == {"out": lake.read_silver(spark, root, "dim_date").count()}


def test_counting_adds_no_pass(spark, two_days):
    """The plan that writes reads the raw table once, whether rows are counted or not."""
    bronze, _ = two_days
    raw = lake.read_bronze(spark, bronze, "customers", DAY)
    counts = RowCounts()
    counted = counts(silver.dim_customers(raw, counts=counts), "out")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") == 1


def test_counts_where_a_join_turns_out_empty(spark):
    orders = spark.createDataFrame(
        [("1", "1", "2024-01-01", "5", "a", "b"), ("x", "1", "zz", "-5", "a", "b")],
        "order_id string, customer_id string, order_date string, total_amount string, "
        "payment_method string, shipping_country string",
    )
    none = spark.createDataFrame([], "customer_id bigint")
    counts = RowCounts()
    counts(silver.fact_orders(orders, none, counts=counts), "out").collect()
    found = counts.dropped()
    assert (found["in"], found["filtered"], found["orphan"], found["out"]) == (2, 1, 1, 0)
    assert (found["bad_order_id"], found["bad_order_date"]) == (1, 1)


# Days of changes.


def changes_bronze(spark, root):
    """Day one has most orders, some with another amount; day two what is new or changed."""
    tables = {t: make(spark, "/root/testdata/sf0.001") for t, make in adapter.BRONZE.items()}
    order = F.col("order_id").cast("long")
    wrong = F.when(order % 5 == 0, F.lit("1.5")).otherwise(F.col("total_amount"))
    one = tables | {
        "orders": tables["orders"].where(order % 3 != 0).withColumn("total_amount", wrong),
        "order_items": tables["order_items"].where(order % 3 != 0),
    }
    two = {
        "customers": tables["customers"].limit(0),
        "products": tables["products"].limit(0),
        "orders": tables["orders"].where((order % 3 == 0) | (order % 5 == 0)),
        "order_items": tables["order_items"].where(order % 3 == 0),
        "product_reviews": tables["product_reviews"].limit(0),
    }
    for day, parts in ((DAY, one), (NEXT_DAY, two)):
        jobs.run_bronze(parts, root, day)
    return tables


@pytest.fixture(scope="module")
def changes(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("changes"))
    tables = changes_bronze(spark, f"{root}/bronze")
    jobs.run_silver(spark, f"{root}/bronze", f"{root}/silver", DAY)
    jobs.run_silver(spark, f"{root}/bronze", f"{root}/silver", NEXT_DAY, changes=True)
    jobs.run_bronze(tables, f"{root}/bronze-whole", DAY)
    jobs.run_silver(spark, f"{root}/bronze-whole", f"{root}/whole", DAY)
    return root


def test_changes_add_up_to_the_whole(spark, changes):
    for table in SILVER:
        as_of = lake.read_silver(spark, f"{changes}/silver", table, lake.AsOf())
        assert rows(as_of) == rows(lake.read_silver(spark, f"{changes}/whole", table)), table
        first = lake.read_silver(spark, f"{changes}/silver", table, lake.AsOf(DAY))
        assert rows(first) == rows(lake.read_silver(spark, f"{changes}/silver", table, DAY))
    marts, whole = {}, {}
    jobs.run_gold(spark, collect_sink(marts), root=f"{changes}/silver", snapshot=lake.AsOf())
    jobs.run_gold(spark, collect_sink(whole), root=f"{changes}/whole")
    assert marts == whole
    catalog.register_silver(spark, "changes_test", f"{changes}/silver")
    by_catalog = catalog.read_table(spark, "changes_test", "fact_orders", lake.AsOf())
    assert rows(by_catalog) == rows(lake.read_silver(spark, f"{changes}/whole", "fact_orders"))
    spark.sql("DROP DATABASE changes_test CASCADE")


def test_no_table_is_shuffled_only_to_be_written(spark, changes, tmp_path, monkeypatch):
    shutil.copytree(f"{changes}/silver", root := str(tmp_path / "silver"))
    hints, hint, stage = [], type(spark.range(1)).hint, lake.stage_silver
    staged = []

    def seen(df, name, *args):
        hints.append(name)
        return hint(df, name, *args)

    def kept(df, root, table, *args, **how):
        staged.append((table, "Exchange" in df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, root, table, *args, **how)

    monkeypatch.setattr(type(spark.range(1)), "hint", seen)
    monkeypatch.setattr(lake, "stage_silver", kept)
    jobs.run_silver(spark, f"{changes}/bronze", root, DAY)
    jobs.compact_silver(spark, root, NEXT_DAY)
    assert "rebalance" not in hints
    assert sorted(staged) == sorted((table, True) for table in [*SILVER, *SILVER])


def test_changes_read_by_one_group_limit(spark, changes):
    as_of = lake.read_silver(spark, f"{changes}/silver", "fact_orders", lake.AsOf())
    plan = as_of._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") == 1
    assert plan.count("WindowGroupLimit") == 2


def many_products(spark, n):
    """Raw tables with few facts, and dimensions of many rows in small files."""
    text = lambda name: F.lit("x").alias(name)
    ids = lambda df, *names: df.select(
        *(F.col("id").cast("string").alias(name) for name in names), "*"
    )
    few = spark.range(0, 3 * n, n // 5)
    day = F.lit("2024-01-05")
    return {
        "customers": ids(spark.range(n), "customer_id").select(
            "customer_id", text("gender"), text("country"), day.alias("signup_date")
        ),
        "products": ids(spark.range(n), "product_id").select(
            "product_id", text("product_name"), text("category"), text("brand"),
            F.lit("1.5").alias("price"), F.lit("2").alias("stock_quantity"),
        ),
        "orders": ids(few, "order_id", "customer_id").select(
            "order_id", "customer_id", day.alias("order_date"), F.lit("3").alias("total_amount"),
            text("payment_method"), text("shipping_country"),
        ),
        "order_items": ids(few, "order_item_id", "order_id", "product_id").select(
            "order_item_id", "order_id", "product_id", F.lit("2").alias("quantity"),
            F.lit("1.5").alias("unit_price"),
        ),
        "product_reviews": ids(few, "review_id", "product_id", "customer_id").select(
            "review_id", "product_id", "customer_id", F.lit("4").alias("rating"),
            day.alias("review_date"),
        ),
    }


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Bronze of a day with many customers and products, and one with changed facts only."""
    root, tables = str(tmp_path_factory.mktemp("many")), many_products(spark, 600_000)
    none = {t: tables[t].limit(0) for t in ("customers", "products")}
    jobs.run_bronze(tables, root, DAY)
    jobs.run_bronze(tables | none, root, NEXT_DAY)
    return root


def test_many_rows_are_not_broadcast_whatever_their_files_take(
    spark, many, tmp_path, monkeypatch
):
    root, plans, stage = str(tmp_path / "silver"), {}, lake.stage_silver

    def seen(df, table):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()

    def kept(df, root, table, *args, **how):
        seen(df, table)
        return stage(df, root, table, *args, **how)

    def parents_merged(*tables):
        for table in tables:
            assert "SortMergeJoin" in plans[table] and "Broadcast" not in plans[table], table
        plans.clear()

    facts, marts = ("fact_orders", "fact_order_items", "fact_reviews"), set(GOLD)
    joined = marts - {"dm_sales_daily"}
    monkeypatch.setattr(lake, "stage_silver", kept)
    jobs.run_silver(spark, many, root, DAY)
    parents_merged(*facts)
    jobs.run_silver(spark, many, root, NEXT_DAY, changes=True)
    parents_merged(*facts)
    for snapshot in (DAY, lake.AsOf(), lake.ALL):
        jobs.run_gold(spark, seen, root=root, snapshot=snapshot)
        parents_merged(*joined)
        inputs = jobs.read_gold_inputs(spark, root=root, snapshot=snapshot)
        for table, df in jobs.datamarts(inputs).items():
            seen(df, table)
        # The others join sums of the few facts, which may be broadcast.
        parents_merged("dm_sales_by_product", "dm_customer_metrics")
    for table in facts:
        # Keys are multiples of 120,000 up to 1,680,000; parents end at 599,999.
        assert lake.read_silver(spark, root, table, lake.AsOf()).count() == 5


def test_few_rows_may_be_broadcast(spark, lakehouse, tmp_path, monkeypatch):
    plans, stage = {}, lake.stage_silver

    def kept(df, root, table, *args, **how):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, root, table, *args, **how)

    monkeypatch.setattr(lake, "stage_silver", kept)
    jobs.run_silver(spark, f"{lakehouse}/bronze", str(tmp_path), DAY)
    assert "Broadcast" in plans["fact_orders"] and "Broadcast" in plans["fact_order_items"]


def test_the_record_tells_the_rows_of_its_runs(spark, changes, tmp_path):
    shutil.copytree(f"{changes}/silver", root := str(tmp_path / "silver"))

    def stored(snapshot, table):
        return lake.read_silver(spark, root, table, snapshot).count()

    for day in (DAY, NEXT_DAY):
        rows_of = lake.day_record(spark, root, day).rows
        assert rows_of == {t: stored(day, t) for t in SILVER}
    both = lake.pin(spark, root, lake.ALL)
    assert lake.known_rows(both, "fact_orders") == stored(lake.ALL, "fact_orders")
    jobs.compact_silver(spark, root, NEXT_DAY)
    assert lake.day_record(spark, root, NEXT_DAY).rows == {t: stored(NEXT_DAY, t) for t in SILVER}
    # A run that nobody counted makes the day's number unknown, not that of the run before.
    lake.write_silver(
        lake.read_silver(spark, root, "dim_products", DAY), root, "dim_products", NEXT_DAY
    )
    record = lake.day_record(spark, root, NEXT_DAY)
    assert lake.known_rows(record, "dim_products") is None
    assert lake.known_rows(record, "dim_customers") == stored(NEXT_DAY, "dim_customers")
    assert lake.known_rows(lake.pin(spark, root, lake.ALL), "dim_products") is None


def test_compaction_keeps_the_snapshots(spark, changes, tmp_path):
    root = str(tmp_path / "silver")
    shutil.copytree(f"{changes}/silver", root)
    before = {t: rows(lake.read_silver(spark, root, t, lake.AsOf())) for t in SILVER}
    jobs.compact_silver(spark, root, NEXT_DAY)
    record = lake.day_record(spark, root, NEXT_DAY)
    assert record.full and record.unique_ids
    for table in SILVER:
        assert rows(lake.read_silver(spark, root, table, lake.AsOf())) == before[table]
        assert rows(lake.read_silver(spark, root, table, NEXT_DAY)) == before[table]
        first = lake.read_silver(spark, root, table, lake.AsOf(DAY))
        assert rows(first) == rows(lake.read_silver(spark, root, table, DAY))
    files_read = lake.read_silver(spark, root, "fact_orders", lake.AsOf()).inputFiles()
    assert all("ingest_day=1/" in f for f in files_read)
    with pytest.raises(ValueError, match="not complete"):
        jobs.compact_silver(spark, root, date(2030, 1, 1))


def test_the_record_saves_the_distinct_counts(spark, lakehouse):
    plans = {}

    def sink(df, table):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()

    jobs.run_gold(spark, sink, database="lakehouse")
    told = dict(plans)
    jobs.run_gold(spark, sink, database="lakehouse", unique_ids=False)
    assert plans["dm_sales_daily"].count("Exchange") > told["dm_sales_daily"].count("Exchange")


def test_jdbc_sink_stores_before_it_writes(spark, monkeypatch):
    seen = {}

    def write(df, url, table, **how):
        seen["plan"] = df._jdf.queryExecution().executedPlan().toString()
        seen["rows"], seen["table"] = df.count(), table

    monkeypatch.setattr(jobs, "write_jdbc", write)
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    jobs.jdbc_sink("jdbc:x:y", "gold", num_partitions=2)(df, "dm")
    assert seen["table"] == "gold.dm" and seen["rows"] == 7
    assert "FileScan parquet" in seen["plan"] and "Aggregate" not in seen["plan"]


def test_datamarts_of_a_database_change_together(spark, lakehouse, monkeypatch):
    """The staged tables and the statements, in a database of this process; the connection of
    the driver is not made here."""
    base = duckdb.connect()
    base.execute("CREATE SCHEMA gold")
    base.execute("CREATE TABLE gold.dm_sales_daily AS SELECT DATE '2000-01-01' AS date, 1.0::DOUBLE AS "
                 "total_revenue, 2::BIGINT AS total_orders, 3.0::DOUBLE AS avg_order_value")  # fmt: skip
    base.execute("CREATE INDEX by_date ON gold.dm_sales_daily (date)")
    lock = threading.Lock()

    def write(df, url, table, truncate, options, **how):
        assert not truncate and options == {"user": "u"}
        staged = df.toPandas()
        with lock:
            base.register("staged", staged)
            base.execute(f"CREATE OR REPLACE TABLE {table} AS SELECT * FROM staged")

    def together(spark_, url, statements, options):
        base.execute("BEGIN")
        try:
            for text in statements:
                base.execute(text)
            base.execute("COMMIT")
        except Exception:
            base.execute("ROLLBACK")
            raise

    monkeypatch.setattr(jobs, "write_jdbc", write)
    monkeypatch.setattr(jobs, "run_in_transaction", together)
    sink = jobs.JdbcSink("jdbc:x:y", "gold", {"user": "u"})
    jobs.run_gold(spark, sink, database="lakehouse")
    expected = {}
    jobs.run_gold(spark, collect_sink(expected), database="lakehouse")

    def sizes():
        return {t: base.execute(f"SELECT count(*) FROM gold.{t}").fetchone()[0] for t in GOLD}

    first = sizes()
    assert first == {t: len(r) for t, r in expected.items()}
    shown = base.execute("SELECT table_name FROM information_schema.tables WHERE table_schema = 'gold'").fetchall()
    assert sorted(n for (n,) in shown) == sorted(GOLD)
    assert base.execute("SELECT count(*) FROM duckdb_indexes()").fetchone() == (1,)

    class Short(jobs.JdbcSink):
        def __call__(self, df, table):
            narrow = table == "dm_stock_performance"
            super().__call__(df.limit(1).drop("product_name") if narrow else df.limit(1), table)

    with pytest.raises(duckdb.Error):
        jobs.run_gold(spark, Short("jdbc:x:y", "gold", {"user": "u"}), database="lakehouse")
    assert sizes() == first


def test_a_transaction_is_taken_back(spark):
    done = []

    class Java:
        """Stands in for the driver's connection."""

        def __getattr__(self, name):
            if name in ("java", "lang", "util", "sql", "Class", "DriverManager"):
                return self

            def call(*args):
                done.append((name, *(a for a in args if isinstance(a, str | bool))))
                if args == ("bad",):
                    raise RuntimeError("no")
                return self

            return call

    class Session:
        _jvm = Java()

    run_in_transaction(Session(), "jdbc:x:y", ["one"], {"driver": "d", "user": "u"})
    names = [n for n, *_ in done]
    assert done[0] == ("forName", "d") and ("setProperty", "user", "u") in done
    assert names[-3:] == ["execute", "commit", "close"]
    done.clear()
    with pytest.raises(RuntimeError, match="no"):
        run_in_transaction(Session(), "jdbc:x:y", ["one", "bad", "two"])
    assert [n for n, *_ in done][-2:] == ["rollback", "close"] and ("execute", "two") not in done


def test_bronze_checks_sources_before_writing(spark, tmp_path):
    with pytest.raises(ValueError, match="orders lacks"):
        jobs.run_bronze({"orders": spark.range(1)}, str(tmp_path), DAY)
    with pytest.raises(ValueError, match="unknown raw tables x"):
        jobs.run_bronze({"x": spark.range(1)}, str(tmp_path), DAY)
    assert list(tmp_path.iterdir()) == []


def test_jobs_take_the_date_they_are_given(spark, lakehouse):
    assert lake.latest_snapshot(spark, f"{lakehouse}/silver") == DAY


def test_session_helpers(spark):
    assert open_session("again") is spark
    assert skew_is_split(spark)
    assert shuffle_partitions_for(0, cores=16) == 16
    assert shuffle_partitions_for(100 * 1024**4) == 100 * 1024**4 // (128 << 20)


def test_warns_when_skew_is_not_split(with_conf, caplog):
    from stratacart.session import warn_unless_skew_is_split

    session = with_conf(spark__sql__adaptive__enabled="false")
    warn_unless_skew_is_split(session, salt=8)
    assert caplog.text == ""
    warn_unless_skew_is_split(session, salt=1)
    assert "salt" in caplog.text


def test_scratch_is_in_the_shared_folder(spark, with_conf):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(f"{base}/x-")
    df, path = materialize(spark.range(3), "x")
    assert df.count() == 3 and path.startswith(base)
    discard(spark, path)
    assert not files.exists(spark, path)


LEAVES = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, {home!r})
from stratacart.sources.scratch import materialize
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {folder!r}).getOrCreate())
kept, path = materialize(spark.range(3), "kept")
assert kept.count() == 3
print(path)
spark.stop()
"""


def test_scratch_goes_with_the_application(tmp_path):
    home = str(Path(__file__).resolve().parents[1])
    code = LEAVES.format(home=home, folder=str(tmp_path))
    done = subprocess.run(
        [sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True
    )
    assert done.stdout.strip().startswith(f"{tmp_path}/kept-")
    for _ in range(100):
        if not list(tmp_path.glob("kept-*")):
            break
        time.sleep(0.1)
    assert list(tmp_path.glob("kept-*")) == []


def test_scratch_that_may_not_be_shared_is_told(caplog):
    class Conf:
        def get(self, name, default=""):
            return None if default is None else "/tmp/warehouse"

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    assert scratch_root(Session()) == "/tmp/warehouse/_scratch"
    assert "spark.checkpoint.dir is unset" in caplog.text
