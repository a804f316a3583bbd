from __future__ import annotations

from datetime import date, timedelta

import pytest
from conftest import DAY, NEXT_DAY
from pyspark.sql import functions as F

from stratacart.schemas import GOLD_INPUTS, SILVER, columns, ddl
from stratacart.sources import catalog, files, lake


@pytest.fixture
def dates_table(spark):
    def make(*days):
        rows = [(d, d.year, d.month, d.day, 1, 1) for d in days]
        return spark.createDataFrame(rows, ddl(SILVER["dim_date"]))

    return make


def keys(df):
    return sorted(r.date_key for r in df.collect())


ONE, TWO = date(2020, 1, 1), date(2020, 1, 2)


def test_rerun_replaces_its_day_only(spark, tmp_path, dates_table):
    root = str(tmp_path)
    lake.write_silver(dates_table(ONE, TWO), root, "dim_date", DAY)
    lake.write_silver(dates_table(TWO), root, "dim_date", NEXT_DAY)
    lake.write_silver(dates_table(ONE), root, "dim_date", DAY)
    assert keys(lake.read_silver(spark, root, "dim_date", DAY)) == [ONE]
    assert keys(lake.read_silver(spark, root, "dim_date", NEXT_DAY)) == [TWO]
    assert keys(lake.read_silver(spark, root, "dim_date", lake.ALL)) == [ONE, TWO]
    for day in (DAY, NEXT_DAY):
        lake.complete_day(spark, root, day, ["dim_date"])
    assert keys(lake.read_silver(spark, root, "dim_date")) == [TWO]


def test_append_adds_a_copy(spark, tmp_path, dates_table):
    root = str(tmp_path)
    for _ in range(2):
        lake.write_silver(dates_table(ONE), root, "dim_date", DAY, mode="append")
    assert keys(lake.read_silver(spark, root, "dim_date", DAY)) == [ONE, ONE]
    with pytest.raises(ValueError, match="mode"):
        lake.write_silver(dates_table(ONE), root, "dim_date", DAY, mode="ignore")


def test_empty_rerun_empties_its_day(spark, tmp_path, dates_table):
    root = str(tmp_path)
    lake.write_silver(dates_table(ONE), root, "dim_date", DAY)
    lake.write_silver(dates_table(ONE), root, "dim_date", NEXT_DAY)
    lake.write_silver(dates_table(ONE).where("false"), root, "dim_date", DAY)
    assert keys(lake.read_silver(spark, root, "dim_date", DAY)) == []
    assert keys(lake.read_silver(spark, root, "dim_date", NEXT_DAY)) == [ONE]


def test_first_run_without_rows_still_makes_the_day(spark, tmp_path, dates_table):
    root = str(tmp_path)
    lake.write_silver(dates_table(ONE).where("false"), root, "dim_date", DAY)
    assert keys(lake.read_silver(spark, root, "dim_date", DAY)) == []


def test_failed_rerun_keeps_the_old_day(spark, tmp_path, dates_table):
    root = str(tmp_path)
    lake.write_silver(dates_table(ONE), root, "dim_date", DAY)
    broken = dates_table(TWO).withColumn("year", F.raise_error(F.lit("boom")).cast("int"))
    with pytest.raises(Exception, match="boom"):
        lake.write_silver(broken, root, "dim_date", DAY)
    assert keys(lake.read_silver(spark, root, "dim_date", DAY)) == [ONE]


def test_days_sort_as_dates_not_as_text(spark, tmp_path):
    root = str(tmp_path)
    for day in [date(2024, 9, 30), date(2024, 10, 2), date(2024, 10, 10), date(2023, 12, 31)]:
        lake.complete_day(spark, root, day, ["dim_date"])
    assert lake.latest_snapshot(spark, root, ["dim_date"]) == date(2024, 10, 10)


def test_latest_snapshot_goes_by_records(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="complete"):
        lake.latest_snapshot(spark, root)
    lake.complete_day(spark, root, DAY, list(SILVER), unique_ids=True)
    lake.complete_day(spark, root, NEXT_DAY, ["dim_products"])
    assert lake.latest_snapshot(spark, root) == DAY
    assert lake.latest_snapshot(spark, root, ["dim_products"]) == NEXT_DAY
    assert lake.day_record(spark, root, DAY).unique_ids
    assert not lake.day_record(spark, root, NEXT_DAY).unique_ids
    lake.begin_day(spark, root, NEXT_DAY)
    assert lake.latest_snapshot(spark, root, ["dim_products"]) == DAY
    assert lake.day_record(spark, root, NEXT_DAY) is None


def test_silver_parts_are_written_as_they_come(spark, tmp_path):
    rows = spark.createDataFrame(
        [(ONE, 2024, n, 1, 1, 1) for n in range(1, 7)], ddl(SILVER["dim_date"])
    )
    root = str(tmp_path)
    lake.write_silver(rows.repartition(3), root, "dim_date", DAY, deal=False)
    folder = lake.run_path(root, "dim_date", DAY, lake.day_state(spark, root, DAY).runs["dim_date"])
    written = [n for n in files.child_files(spark, folder) if n.endswith(".parquet")]
    assert len(written) == 3 and all(".zstd." in n for n in written)
    assert sorted(lake.read_silver(spark, root, "dim_date", DAY).collect()) == sorted(rows.collect())


def test_silver_files_are_not_tiny(spark, tmp_path):
    rows = spark.range(200_000, numPartitions=40).select(
        F.lit(ONE).alias("date_key"),
        *[(F.col("id") % m).cast("int").alias(n) for m, n in ((97, "year"), (89, "month"))],
        *[F.lit(1).alias(n) for n in ("day", "week", "quarter")],
    )
    lake.write_silver(rows, str(tmp_path), "dim_date", DAY)
    run = lake.day_state(spark, str(tmp_path), DAY).runs["dim_date"]
    folder = lake.run_path(str(tmp_path), "dim_date", DAY, run)
    assert len([n for n in files.child_files(spark, folder) if n.endswith(".parquet")]) < 8


def test_bronze_reads_one_leaf_without_partition_columns(spark, tmp_path):
    root = str(tmp_path)
    lake.write_bronze(spark.range(3), root, "orders", DAY)
    lake.write_bronze(spark.range(5), root, "orders", NEXT_DAY)
    df = lake.read_bronze(spark, root, "orders", DAY)
    assert df.columns == ["id"] and df.count() == 3
    assert all("year=2024/month=1/day=31" in path for path in df.inputFiles())


def test_records_are_folded_in_order(spark, tmp_path, dates_table):
    root = str(tmp_path)
    for n in range(4):
        lake.write_silver(dates_table(*([ONE] * (n + 1))), root, "dim_date", DAY)
        lake.write_silver(dates_table(TWO), root, "fact_reviews", DAY)
    state = lake.day_state(spark, root, DAY)
    assert set(state.runs) == {"dim_date", "fact_reviews"} and not state.tables
    assert len(keys(lake.read_silver(spark, root, "dim_date", DAY))) == 4
    assert lake.history(spark, root) == [state]
    leaf = lake.leaf_path(root, "dim_date", lake.SILVER_PARTITION, DAY)
    assert len(files.child_folders(spark, leaf)) == 2


def test_old_records_are_cleared(spark, tmp_path, dates_table):
    root = str(tmp_path)
    for _ in range(5):
        run = lake.new_run()
        lake.stage_silver(dates_table(ONE), root, "dim_date", DAY, run)
        lake.commit_day(spark, root, DAY, {"dim_date": run}, tables=["dim_date"])
    assert len(lake.record_names(spark, root)) == 2
    assert lake.day_record(spark, root, DAY).runs == {"dim_date": run}


def test_a_broken_record_is_named(spark, tmp_path, dates_table):
    root = str(tmp_path)
    for text in (b"", b"[1]"):
        files.write_bytes(spark, f"{root}/_days/{lake.RecordName(DAY, lake._stamp()).file}", text)
        with pytest.raises(ValueError, match="no record of a day"):
            lake.day_state(spark, root, DAY)


def test_a_record_cleared_while_it_is_read(spark, tmp_path, dates_table, monkeypatch):
    root, read = str(tmp_path), files.read_bytes
    lake.write_silver(dates_table(ONE), root, "dim_date", DAY)
    gone = lake.record_names(spark, root)[0]

    def cleared(spark_, path):
        if files.exists(spark, f"{root}/_days/{gone.file}"):
            lake.write_silver.__globals__["files"].delete(spark, f"{root}/_days/{gone.file}")
            files.write_bytes(
                spark, f"{root}/_days/{lake.RecordName(DAY, lake._stamp()).file}", b'{"runs": {}}'
            )
        return read(spark_, path)

    monkeypatch.setattr(files, "read_bytes", cleared)
    assert lake.day_state(spark, root, DAY).runs == {}


def test_a_table_that_was_not_written_is_named(spark, tmp_path, dates_table):
    lake.write_silver(dates_table(ONE), str(tmp_path), "dim_date", DAY)
    with pytest.raises(ValueError, match="no fact_orders of 2024-01-31"):
        lake.read_silver(spark, str(tmp_path), "fact_orders", DAY)


def test_files_are_not_rewritten(spark, tmp_path):
    files.write_bytes(spark, str(tmp_path / "x"), b"one")
    with pytest.raises(FileExistsError):
        files.write_bytes(spark, str(tmp_path / "x"), b"two")
    assert files.read_bytes(spark, str(tmp_path / "x")) == b"one"


def test_newest_of_each_key(spark, tmp_path, dates_table):
    root, days = str(tmp_path), [date(2024, 1, n) for n in (1, 2, 3)]
    rows = [[(ONE, 1), (TWO, 1), (None, 1)], [(ONE, 2), (None, 2)], [(TWO, 3)]]
    for day, part in zip(days, rows, strict=True):
        df = spark.createDataFrame(
            [(k, v, 1, 1, 1, 1) for k, v in part], ddl(SILVER["dim_date"])
        )
        lake.write_silver(df, root, "dim_date", day)
        lake.commit_day(spark, root, day, tables=["dim_date"], full=False)

    def seen(day=None):
        df = lake.read_silver(spark, root, "dim_date", lake.AsOf(day))
        return {r.date_key: r.year for r in df.collect()}

    assert seen(days[0]) == {ONE: 1, TWO: 1, None: 1}
    assert seen(days[1]) == {ONE: 2, TWO: 1, None: 2}
    assert seen() == seen(days[2]) == {ONE: 2, TWO: 3, None: 2}
    lake.commit_day(spark, root, days[1], full=True)
    assert seen() == {ONE: 2, None: 2, TWO: 3}
    lake.begin_day(spark, root, days[2])
    assert seen() == {ONE: 2, None: 2}
    with pytest.raises(ValueError, match="complete"):
        seen(date(2023, 1, 1))


def test_unknown_snapshot(spark, tmp_path):
    with pytest.raises(ValueError, match="snapshot"):
        lake.read_silver(spark, str(tmp_path), "dim_date", "yesterday")


def test_files(spark, tmp_path):
    path = str(tmp_path / "x")
    assert files.any_file(spark, path) is None and files.child_folders(spark, path) == []
    spark.range(1).write.parquet(path + "/a=1")
    assert files.child_folders(spark, path) == ["a=1"] and files.child_files(spark, path) == []
    assert files.any_file(spark, path) is None
    assert files.exists(spark, files.any_file(spark, path + "/a=1"))
    files.delete(spark, path)
    assert not files.exists(spark, path)


@pytest.fixture
def database(spark):
    name = "catalog_test"
    catalog.create_database(spark, name)
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_catalog(spark, tmp_path, dates_table, database, executed_plan):
    root = str(tmp_path)
    lake.write_silver(dates_table(ONE), root, "dim_date", DAY)
    catalog.register_table(spark, database, "dim_date", root)
    assert keys(catalog.read_table(spark, database, "dim_date", lake.ALL)) == []
    catalog.repair_partitions(spark, database, "dim_date")
    assert keys(catalog.read_table(spark, database, "dim_date", lake.ALL)) == [ONE]

    lake.complete_day(spark, root, DAY, ["dim_date"])
    lake.write_silver(dates_table(TWO), root, "dim_date", NEXT_DAY)
    assert keys(catalog.read_table(spark, database, "dim_date")) == [ONE]
    lake.complete_day(spark, root, NEXT_DAY, ["dim_date"])
    catalog.repair_partitions(spark, database, "dim_date")
    latest = catalog.read_table(spark, database, "dim_date")
    assert keys(latest) == [TWO] and latest.columns == columns(SILVER["dim_date"])
    plan = executed_plan(latest)
    assert "ingest_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert keys(catalog.read_table(spark, database, "dim_date", lake.ALL)) == [ONE, TWO]

    catalog.drop_table(spark, database, "dim_date")
    assert not spark.catalog.tableExists(f"{database}.dim_date")
    assert keys(lake.read_silver(spark, root, "dim_date", DAY)) == [ONE]


def test_repair_touches_what_is_new(spark, tmp_path, dates_table, database, monkeypatch):
    """Days that the catalog has already seen are neither listed nor read again."""
    root, days = str(tmp_path), [date(2023, 12, n) for n in range(1, 6)]
    for day in days:
        lake.write_silver(dates_table(ONE), root, "dim_date", day)
    catalog.register_table(spark, database, "dim_date", root)
    assert catalog.repair_partitions(spark, database, "dim_date") == days
    monkeypatch.setattr(catalog, "_CLOCKS", timedelta(0))
    lake.write_silver(dates_table(ONE, TWO), root, "dim_date", days[1])
    lake.write_silver(dates_table(TWO), root, "dim_date", DAY)
    listed, child = [], files.child_folders
    monkeypatch.setattr(files, "child_folders", lambda s, p: listed.append(p) or child(s, p))
    changed = catalog.repair_partitions(spark, database, "dim_date")
    assert set(changed) - {days[-1]} == {days[1], DAY} and listed == []
    table = spark.table(f"{database}.dim_date")
    assert table.where("ingest_day = 2").count() == 2 and table.count() == 7
    assert spark.sql(f"SHOW PARTITIONS {database}.dim_date").count() == 6


def test_partitions_of_a_rerun_move(spark, tmp_path, dates_table, database):
    root = str(tmp_path)
    lake.write_silver(dates_table(ONE), root, "dim_date", DAY)
    catalog.register_table(spark, database, "dim_date", root)
    catalog.repair_partitions(spark, database, "dim_date")
    lake.write_silver(dates_table(TWO), root, "dim_date", DAY)
    assert keys(spark.table(f"{database}.dim_date")) == [ONE]
    catalog.repair_partitions(spark, database, "dim_date")
    assert keys(spark.table(f"{database}.dim_date")) == [TWO]


def reviews(spark, *ids):
    rows = [(1, 1, i, 5, ONE) for i in ids]
    return spark.createDataFrame(rows, ddl(SILVER["fact_reviews"], "bigint"))


def test_an_older_declaration_follows(spark, tmp_path, database):
    """Registered as int at one root, then as bigint at another."""
    roots = [str(tmp_path / n) for n in "ab"]
    for root in roots:
        lake.write_silver(reviews(spark, 1, 3_000_000_000), root, "fact_reviews", DAY)
        lake.complete_day(spark, root, DAY, ["fact_reviews"])
    small = spark.createDataFrame([(1, 1, 7, 5, ONE)], ddl(SILVER["fact_reviews"], "int"))
    lake.write_silver(small, roots[0], "fact_reviews", DAY)
    for root, kind, ids in (
        (roots[0], "int", [7]),
        (roots[0], "bigint", [7]),
        (roots[1], "bigint", [1, 3_000_000_000]),
        (roots[1], "bigint", [1, 3_000_000_000]),
    ):
        catalog.register_table(spark, database, "fact_reviews", root, kind)
        catalog.repair_partitions(spark, database, "fact_reviews")
        found = catalog.read_table(spark, database, "fact_reviews", DAY)
        assert dict(found.dtypes)["review_id"] == kind
        assert sorted(r.review_id for r in found.collect()) == ids
        assert catalog.silver_root(spark, database, "fact_reviews").endswith(root)
    there = catalog.declared(spark, database, "fact_reviews")
    assert there.columns[0] == ("customer_id", "bigint") and there.kind == "EXTERNAL"
    assert there.partition == lake.SILVER_PARTITION


def test_new_columns_are_added_in_place(spark, tmp_path, database):
    fields = ", ".join(f"{n} INT" for n in lake.SILVER_PARTITION)
    spark.sql(
        f"CREATE TABLE {database}.dim_date (date_key DATE, year INT, {fields}) USING parquet "
        f"PARTITIONED BY ({', '.join(lake.SILVER_PARTITION)}) LOCATION '{tmp_path}/dim_date'"
    )
    spark.sql(f"ALTER TABLE {database}.dim_date SET TBLPROPERTIES ('own' = 'kept')")
    catalog.register_table(spark, database, "dim_date", str(tmp_path))
    assert catalog.declared(spark, database, "dim_date").columns == SILVER["dim_date"]
    kept = spark.sql(f"SHOW TBLPROPERTIES {database}.dim_date ('own')").head()
    assert kept["value"] == "kept"


def test_what_is_no_external_table_is_left_alone(spark, tmp_path, database):
    spark.range(2).write.saveAsTable(f"{database}.dim_date")
    spark.sql(f"CREATE VIEW {database}.fact_orders AS SELECT 1 AS x")
    for table in ("dim_date", "fact_orders"):
        with pytest.raises(ValueError, match=f"{table} is no external"):
            catalog.register_table(spark, database, table, str(tmp_path))
    assert spark.table(f"{database}.dim_date").count() == 2


def test_register_silver_twice_and_use(spark, tmp_path, database):
    root = str(tmp_path)
    for table in SILVER:
        empty = spark.createDataFrame([], ddl(SILVER[table], "bigint"))
        lake.write_silver(empty, root, table, DAY)
    lake.complete_day(spark, root, DAY, list(SILVER))
    for _ in range(2):
        catalog.register_silver(spark, database, root, "bigint")
    assert catalog.latest_snapshot(spark, database) == DAY
    assert {t.name for t in spark.catalog.listTables(database)} == set(SILVER)
    kinds = dict(catalog.read_table(spark, database, "fact_orders", DAY).dtypes)
    assert kinds["order_id"] == "bigint" and kinds["order_date"] == "date"
    catalog.use_database(spark, database)
    assert spark.catalog.currentDatabase() == database
    catalog.use_database(spark, "default")


def test_catalog_without_a_complete_day(spark, tmp_path, database):
    catalog.register_table(spark, database, "dim_date", str(tmp_path))
    with pytest.raises(ValueError, match="complete"):
        catalog.read_table(spark, database, "dim_date")
