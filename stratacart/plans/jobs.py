"""The batch jobs: land raw tables, build silver for a day, build the datamarts."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import UTC, date, datetime
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from stratacart.operators.aggregates import product_sales
from stratacart.operators.counts import OUT, RowCounts
from stratacart.operators.joins import bounded
from stratacart.plans import gold, silver
from stratacart.schemas import BRONZE, GOLD_INPUTS, SILVER, columns
from stratacart.session import warn_unless_skew_is_split
from stratacart.sources import catalog, files, lake
from stratacart.sources.landing import (
    STAGED,
    require_columns,
    run_in_transaction,
    switch_statements,
    write_jdbc,
)
from stratacart.sources.scratch import discard, materialize

log = logging.getLogger(__name__)

Sink = Callable[[DataFrame, str], None]


@contextmanager
def _logged(job: str) -> Iterator[None]:
    log.info("%s started", job)
    try:
        yield
    except Exception:
        log.exception("%s failed", job)
        raise
    log.info("%s done", job)


def _side_by_side(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """Run independent Spark actions at the same time, so that one fills the executors
    the other's last tasks leave idle. Raises the first error once all have ended."""
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [step.result() for step in running]


def run_bronze(
    sources: Mapping[str, DataFrame], root: str, day: date, mode: str = "overwrite"
) -> None:
    """Land the raw tables (see ``read_csv`` and ``read_jdbc``) under ``day``.

    A scan, three constant columns and a write: no shuffle.
    """
    with _logged("bronze"):
        if unknown := set(sources) - set(BRONZE):
            raise ValueError(f"unknown raw tables {', '.join(sorted(unknown))}")
        for table, df in sources.items():
            require_columns(df, columns(BRONZE[table]), table)
        for table, df in sources.items():
            lake.write_bronze(df, root, table, day, mode)


def run_silver(
    spark: SparkSession,
    bronze_root: str,
    silver_root: str,
    day: date,
    key_type: str = "bigint",
    salt: int = 1,
    changes: bool = False,
) -> None:
    """Build the six silver tables of ``day``, replacing what that day had.

    Everything is written to folders of a new run, and one record then points the day at all
    six: readers see the day as it was before or as it is after, and a run that fails leaves
    it as it was. Every table is written once and read back by those that depend on it, so all
    agree on the same rows and nothing is computed twice.

    ``changes`` says that the raw tables hold only rows that are new or have changed since the
    days before. Keys are then checked against the parents as of this day, and the day is to
    be read by ``AsOf``.

    The record also has how many rows each rule let through, counted as they pass.
    """
    run = lake.new_run()
    counts = {table: RowCounts() for table in SILVER}

    def raw(table: str) -> DataFrame:
        return lake.read_bronze(spark, bronze_root, table, day)

    def store(df: DataFrame, table: str) -> DataFrame:
        # Each ends in the shuffle of its duplicates, its last key check or its grouping.
        lake.stage_silver(counts[table](df, OUT), silver_root, table, day, run, deal=False)
        return lake.read_staged(spark, silver_root, table, day, run, key_type)

    def parent(df: DataFrame, table: str) -> DataFrame:
        rows = counts[table].rows(OUT)
        if not changes:
            return bounded(df, rows)
        return lake.read_with_changes(spark, silver_root, table, day, run, key_type, rows)

    def built(table: str, source: str, *parents: DataFrame) -> DataFrame:
        build = getattr(silver, table)
        extra = (salt,) if parents else ()
        df = build(raw(source), *parents, key_type, *extra, counts=counts[table])
        return store(df, table)

    with _logged("silver"):
        warn_unless_skew_is_split(spark, salt)
        try:
            customers, products = _side_by_side(
                spark,
                lambda: parent(built("dim_customers", "customers"), "dim_customers"),
                lambda: parent(built("dim_products", "products"), "dim_products"),
            )
            orders, _ = _side_by_side(
                spark,
                lambda: built("fact_orders", "orders", customers),
                lambda: built("fact_reviews", "product_reviews", products, customers),
            )
            _side_by_side(
                spark,
                lambda: built(
                    "fact_order_items", "order_items", parent(orders, "fact_orders"), products
                ),
                lambda: store(silver.dim_date(orders), "dim_date"),
            )
            lake.commit_day(
                spark,
                silver_root,
                day,
                dict.fromkeys(SILVER, run),
                tables=list(SILVER),
                unique_ids=True,
                full=not changes,
                counts={t: c.dropped() for t, c in counts.items()},
                rows={t: c.rows(OUT) for t, c in counts.items()},
            )
        except BaseException:
            lake.drop_staged(spark, silver_root, day, run)
            raise


def compact_silver(
    spark: SparkSession, silver_root: str, day: date, key_type: str = "bigint"
) -> None:
    """Write the snapshot as of ``day`` as that day's tables, so that later snapshots start
    there instead of at the first day of changes. What is read as of any day stays the same."""
    with _logged("compaction"):
        pinned = lake.pin(spark, silver_root, lake.AsOf(day), list(SILVER))
        if pinned[-1].day != day:
            raise ValueError(f"{day} is not complete in {silver_root}")
        run = lake.new_run()
        counts = {table: RowCounts() for table in SILVER}
        try:
            for table in SILVER:
                df = lake.read_pinned(spark, silver_root, table, pinned, key_type)
                # Ends in the shuffle by key.
                df = counts[table](df, OUT)
                lake.stage_silver(df, silver_root, table, day, run, deal=False)
            lake.commit_day(
                spark,
                silver_root,
                day,
                dict.fromkeys(SILVER, run),
                tables=list(SILVER),
                unique_ids=all(r.unique_ids for r in pinned),
                full=True,
                rows={t: c.rows(OUT) for t, c in counts.items()},
            )
        except BaseException:
            lake.drop_staged(spark, silver_root, day, run)
            raise


def _run_names() -> str:
    return f"run-{datetime.now(UTC):%Y%m%dT%H%M%S%f}"


class ParquetSink:
    """Store each datamart in a folder of its own, a new one per run.

    ``commit`` marks the run as whole when all datamarts are there, by an empty file that
    appears at once; readers take the newest run with that mark, so the datamarts change
    together and a failed run changes nothing. The run before stays for those who still read
    it; older ones are deleted.
    """

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")
        self.run = _run_names()

    def __call__(self, df: DataFrame, table: str) -> None:
        df.write.parquet(f"{self.root}/{self.run}/{table}")

    def commit(self, spark: SparkSession) -> None:
        files.write_bytes(spark, f"{self.root}/{_MARKS}/{self.run}", b"")
        for old in _marked_runs(spark, self.root)[:-2]:
            files.delete(spark, f"{self.root}/{_MARKS}/{old}")
            files.delete(spark, f"{self.root}/{old}")
        self.run = _run_names()


#: Folder below a ``ParquetSink`` with an empty file per whole run.
_MARKS = "_whole"


def _marked_runs(spark: SparkSession, root: str) -> list[str]:
    names = files.child_files(spark, f"{root}/{_MARKS}")
    return sorted(n for n in names if n.startswith("run-"))


def parquet_sink(root: str) -> ParquetSink:
    return ParquetSink(root)


def read_gold(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A datamart of the last run that a ``ParquetSink`` committed."""
    root = root.rstrip("/")
    runs = _marked_runs(spark, root)
    if not runs:
        raise ValueError(f"no run of the datamarts is complete in {root}")
    return spark.read.parquet(f"{root}/{runs[-1]}/{table}")


class TableSink:
    """Publish each datamart in the catalog, as a view of a table that its run has written.

    Tables of a new run are filled first; ``commit`` then turns the views to them, one
    statement each. If one fails, those turned before are turned back, so that the datamarts
    stay those of one run. A table of an earlier version that has a datamart's own name is
    kept under another one. The run before stays for those who still read it.
    """

    def __init__(self, database: str) -> None:
        self.database = database
        self.run = self._new()
        self.tables: list[str] = []

    @staticmethod
    def _new() -> str:
        return _run_names().replace("-", "_").lower()

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def __call__(self, df: DataFrame, table: str) -> None:
        df.write.mode("errorifexists").saveAsTable(self._name(f"{table}__{self.run}"))
        self.tables.append(table)

    def _turn(self, spark: SparkSession, table: str, run: str) -> None:
        spark.sql(
            f"CREATE OR REPLACE VIEW {self._name(table)} AS "
            f"SELECT * FROM {self._name(f'{table}__{run}')}"
        )

    def _runs(self, spark: SparkSession) -> dict[str, list[str]]:
        """The runs of each datamart that have a table, oldest first."""
        found: dict[str, list[str]] = {t: [] for t in self.tables}
        for shown in spark.catalog.listTables(self.database):
            table, mark, run = shown.name.rpartition("__")
            if mark and table in found:
                found[table].append(run)
        return {t: sorted(runs) for t, runs in found.items()}

    def _shown(self, spark: SparkSession, table: str) -> str | None:
        """The run that the datamart's view is of."""
        if not spark.catalog.tableExists(self._name(table)):
            return None
        text = spark.sql(f"SHOW CREATE TABLE {self._name(table)}").head()[0]
        return text.rpartition(f"{table}__")[2].strip("`; \n)")

    def commit(self, spark: SparkSession) -> None:
        kinds = {t.name: t.tableType for t in spark.catalog.listTables(self.database)}
        for table in self.tables:
            if kinds.get(table, "VIEW") != "VIEW":
                before = f"{table}__run_0before_{self.run}"
                spark.sql(f"ALTER TABLE {self._name(table)} RENAME TO {self._name(before)}")
                self._turn(spark, table, before.partition("__")[2])
        shown = {table: self._shown(spark, table) for table in self.tables}
        turned: list[str] = []
        try:
            for table in self.tables:
                turned.append(table)
                self._turn(spark, table, self.run)
        except BaseException:
            for table in turned:
                if shown[table] is None:
                    spark.sql(f"DROP VIEW IF EXISTS {self._name(table)}")
                else:
                    self._turn(spark, table, shown[table])
            raise
        for table, runs in self._runs(spark).items():
            for old in set(runs) - {self.run, shown[table]}:
                spark.sql(f"DROP TABLE IF EXISTS {self._name(f'{table}__{old}')}")
        self.run, self.tables = self._new(), []

    def abandon(self, spark: SparkSession) -> None:
        """Drop what a run that failed has written."""
        for table in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {self._name(f'{table}__{self.run}')}")
        self.run, self.tables = self._new(), []


def table_sink(database: str) -> TableSink:
    return TableSink(database)


def jdbc_sink(url: str, schema: str, **how) -> Sink:
    """Store each datamart in a relational database; see ``jdbc_write_options``.

    It is computed and stored first, in as many tasks as that takes: Spark's writer narrows
    the frame it gets to the number of connections.
    """

    def write(df: DataFrame, table: str) -> None:
        stored, folder = materialize(df, f"jdbc-{table}")
        try:
            write_jdbc(stored, url, f"{schema}.{table}", **how)
        finally:
            discard(df.sparkSession, folder)

    return write


class JdbcSink:
    """Publish all datamarts of a run in a relational database at once.

    Each is stored and written to a staged table beside its own; ``commit`` moves the rows of
    all in one transaction, so that readers see those of one run and a run that fails changes
    nothing. The tables must have the columns of the datamarts, or the transaction fails.
    """

    def __init__(self, url: str, schema: str, options: Mapping[str, str] | None = None, **how):
        self.url, self.schema = url, schema
        self.options, self.how = dict(options or {}), how
        self.tables: list[str] = []

    def __call__(self, df: DataFrame, table: str) -> None:
        write = jdbc_sink(self.url, self.schema, options=self.options, truncate=False, **self.how)
        write(df, f"{table}{STAGED}")
        self.tables.append(table)

    def commit(self, spark: SparkSession) -> None:
        statements = switch_statements(self.schema, sorted(self.tables))
        run_in_transaction(spark, self.url, statements, self.options)
        self.tables = []

    def abandon(self, spark: SparkSession) -> None:
        """Forget the staged tables; the next run writes them anew."""
        self.tables = []


def _pinned(
    spark: SparkSession, root: str | None, database: str | None, snapshot: lake.Snapshot
):
    """The silver root, and what of it is read whatever is committed meanwhile."""
    if (root is None) == (database is None):
        raise ValueError("give either the silver root folder or the database")
    home = root or catalog.silver_root(spark, database, GOLD_INPUTS[0])
    return home, lake.pin(spark, home, snapshot)


def _inputs(spark: SparkSession, home: str, pinned, key_type: str) -> dict[str, DataFrame]:
    """The silver tables of a pinned snapshot, the dimensions as parents of joins."""
    tables = {t: lake.read_pinned(spark, home, t, pinned, key_type) for t in GOLD_INPUTS}
    return tables | {
        t: bounded(tables[t], lake.known_rows(pinned, t))
        for t in GOLD_INPUTS
        if t.startswith("dim_")
    }


def read_gold_inputs(
    spark: SparkSession,
    *,
    root: str | None = None,
    database: str | None = None,
    snapshot: lake.Snapshot = lake.LATEST,
    key_type: str = "bigint",
) -> dict[str, DataFrame]:
    """The silver tables the datamarts need, all of the same snapshot and of the same runs.

    Of a database the declared types and the folder are taken; the runs come from the records,
    since the catalog's partitions change one by one.
    """
    home, pinned = _pinned(spark, root, database, snapshot)
    if database is not None:
        key_type = catalog.key_type_of(spark, database, GOLD_INPUTS[0])
    return _inputs(spark, home, pinned, key_type)


def datamarts(
    inputs: Mapping[str, DataFrame],
    sales: DataFrame | None = None,
    unique_ids: bool = False,
) -> dict[str, DataFrame]:
    """The five datamarts over the silver tables, not yet computed."""
    orders, items = inputs["fact_orders"], inputs["fact_order_items"]
    products, reviews = inputs["dim_products"], inputs["fact_reviews"]
    return {
        "dm_sales_daily": gold.dm_sales_daily(orders, unique_ids),
        "dm_sales_by_product": gold.dm_sales_by_product(items, products, sales),
        "dm_customer_metrics": gold.dm_customer_metrics(
            orders, inputs["dim_customers"], unique_ids
        ),
        "dm_product_reviews_impact": gold.dm_product_reviews_impact(
            products, reviews, items, sales, unique_ids
        ),
        "dm_stock_performance": gold.dm_stock_performance(products, items, sales),
    }


def run_gold(
    spark: SparkSession,
    sink: Sink,
    *,
    root: str | None = None,
    database: str | None = None,
    snapshot: lake.Snapshot = lake.LATEST,
    key_type: str = "bigint",
    unique_ids: bool | None = None,
) -> None:
    """Build the datamarts from silver folders or tables and hand each to ``sink``; one with
    a ``commit`` publishes them when all are there.

    The items are read and aggregated by product once, for the three datamarts that need
    it. Where no order or review id repeats, counting them needs no extra shuffle; by
    default the day's record tells whether that is so.
    """
    with _logged("gold"):
        home, pinned = _pinned(spark, root, database, snapshot)
        if database is not None:
            key_type = catalog.key_type_of(spark, database, GOLD_INPUTS[0])
        if unique_ids and snapshot == lake.ALL:
            raise ValueError("ids repeat across ingest dates: unique_ids needs one date")
        if unique_ids is None:
            records = [pinned] if isinstance(pinned, lake.DayRecord) else pinned
            unique_ids = not isinstance(pinned, list) and all(r.unique_ids for r in records)
        inputs = _inputs(spark, home, pinned, key_type)
        sales, folder = materialize(
            product_sales(inputs["fact_order_items"]), "product-sales"
        )
        try:
            # A row per known product at most.
            sales = bounded(sales, lake.known_rows(pinned, "dim_products"))
            marts = datamarts(inputs, sales, unique_ids)
            _side_by_side(spark, *(partial(sink, df, table) for table, df in marts.items()))
            if commit := getattr(sink, "commit", None):
                commit(spark)
        except BaseException:
            if abandon := getattr(sink, "abandon", None):
                abandon(spark)
            raise
        finally:
            discard(spark, folder)
