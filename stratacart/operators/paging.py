"""Sorted pages of a datamart.

NULLs sort as the largest value (first when descending, last when ascending). After the
chosen column come the table's key and then its other columns, so pages never overlap.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratacart.schemas import GOLD
from stratacart.sources.scratch import discard, materialize

# Limits and defaults of a page request.
DEFAULT_PAGE_SIZE = 100
MAX_PAGE_SIZE = 1000
DIRECTIONS = ("asc", "desc")

_POSITION = "__position"
_SLOT_BITS = 33


class PageError(ValueError):
    """A page request that cannot be served."""


class UnknownTable(PageError):
    pass


class UnknownColumn(PageError):
    pass


class NotMaterialized(PageError):
    """A known datamart that has no stored table at the moment."""


@dataclass(frozen=True)
class PageRequest:
    table: str
    page: int
    page_size: int
    order_by: str
    order_dir: str

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.page_size


def gold_tables(spark: SparkSession) -> DataFrame:
    """The published datamarts with their endpoint and default sort column."""
    rows = [(name, mart.endpoint, mart.default_sort) for name, mart in GOLD.items()]
    return spark.createDataFrame(rows, "table string, endpoint string, default_sort string")


def gold_columns(df: DataFrame) -> list[str]:
    return df.columns


def stored_gold(spark: SparkSession, database: str, table: str) -> DataFrame:
    """A datamart saved in the catalog."""
    if table not in GOLD:
        raise UnknownTable(f"no datamart is called {table}")
    if not spark.catalog.tableExists(f"`{database}`.`{table}`"):
        raise NotMaterialized(f"{table} is not stored in {database}")
    return spark.table(f"`{database}`.`{table}`")


def check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise PageError("page starts at 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise PageError(f"page_size must be from 1 to {MAX_PAGE_SIZE}")


def validate_page(
    df: DataFrame,
    table: str,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    order_by: str | None = None,
    order_dir: str = "desc",
) -> PageRequest:
    """Check a request against the datamart's columns; runs no Spark job."""
    if table not in GOLD:
        raise UnknownTable(f"no datamart is called {table}")
    check_page(page, page_size)
    if order_dir not in DIRECTIONS:
        raise PageError(f"order_dir must be one of {DIRECTIONS}")
    sort = order_by or GOLD[table].default_sort
    if sort not in df.columns:
        raise UnknownColumn(f"{table} has no column {sort}")
    return PageRequest(table, page, page_size, sort, order_dir)


def _total_order(df: DataFrame, request: PageRequest) -> list[Column]:
    sort = F.col(request.order_by)
    first = sort.desc_nulls_first() if request.order_dir == "desc" else sort.asc_nulls_last()
    names = dict.fromkeys([*GOLD[request.table].key, *df.columns])
    return [first, *(F.col(n).asc_nulls_last() for n in names if n != request.order_by)]


@dataclass(frozen=True)
class PreparedPages:
    """A datamart stored in the order of its pages, until ``close`` deletes the folder.

    ``__position`` has the sort task in its upper bits and the row within the task in the
    lower 33. ``parts`` has a task, the rows before it and its own rows, for each task that
    has any: as many entries as sort tasks, kept by the driver. A page is a few ranges of the
    position, so Parquet statistics leave unread what lies outside, and a page costs the same
    wherever it is.
    """

    spark: SparkSession
    request: PageRequest
    columns: tuple[str, ...]
    schema: StructType
    folder: str
    parts: tuple[tuple[int, int, int], ...]

    @property
    def total_rows(self) -> int:
        return sum(rows for _, _, rows in self.parts)

    def __enter__(self) -> PreparedPages:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        discard(self.spark, self.folder)


def prepare_pages(
    df: DataFrame,
    table: str,
    order_by: str | None = None,
    order_dir: str = "desc",
    root: str | None = None,
    parts: int | None = None,
) -> PreparedPages:
    """Sort the datamart ``df`` in parallel, in as many tasks as Spark sees fit or in
    ``parts``, and store it for reading page by page, below ``root`` or in the scratch folder.
    Close the result when no page is read any more."""
    request = validate_page(df, table, order_by=order_by, order_dir=order_dir)
    order = _total_order(df, request)
    in_order = (
        df.orderBy(*order)
        if parts is None
        else df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    )
    numbered = in_order.withColumn(_POSITION, F.monotonically_increasing_id())
    stored, folder = materialize(numbered, "sorted-pages", root)
    counts = (
        stored.groupBy(F.shiftright(_POSITION, _SLOT_BITS).alias("part"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("part")
        .collect()
    )
    before = accumulate((r["rows"] for r in counts), initial=0)
    placed = tuple((r["part"], n, r["rows"]) for r, n in zip(counts, before, strict=False))
    return PreparedPages(
        df.sparkSession, request, tuple(df.columns), stored.schema, folder, placed
    )


def gold_page(
    pages: PreparedPages, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """One page of a prepared datamart, sorted."""
    check_page(page, page_size)
    start, end = (page - 1) * page_size, page * page_size
    stored = pages.spark.read.schema(pages.schema).parquet(pages.folder)
    wanted = F.lit(False)
    for part, before, rows in pages.parts:
        low, high = max(start - before, 0), min(end - before, rows) - 1
        if low <= high:
            base = part << _SLOT_BITS
            wanted |= F.col(_POSITION).between(base + low, base + high)
    return stored.where(wanted).orderBy(_POSITION).select(*pages.columns)


def page_info(
    df: DataFrame,
    table: str,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    order_by: str | None = None,
    order_dir: str = "desc",
) -> DataFrame:
    """What accompanies a page, in one row: row and page totals, the sort and the columns."""
    request = validate_page(df, table, page, page_size, order_by, order_dir)
    total = F.count(F.lit(1))
    return df.agg(total.alias("total_rows")).select(
        F.lit(table).alias("table"),
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        "total_rows",
        F.expr(f"(total_rows + {page_size - 1}) DIV {page_size}").alias("total_pages"),
        F.lit(request.order_by).alias("order_by"),
        F.lit(order_dir).alias("order_dir"),
        F.array(*[F.lit(name) for name in gold_columns(df)]).alias("columns"),
    )
