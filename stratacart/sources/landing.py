"""Raw inputs: CSV files with a header, and tables of a relational database."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from decimal import Decimal
from functools import reduce
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession

from stratacart.sources import files

JDBC_BATCH_ROWS = 10_000
#: How much of a CSV file may be header, and how many files' beginnings are read at a time.
HEADER_BYTES = 64 << 10
HEADERS_TOGETHER = 16


def require_columns(df: DataFrame, required: Sequence[str], what: str) -> DataFrame:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
    return df


def _header(spark: SparkSession, path: str, options: Mapping[str, str]) -> tuple[str, ...]:
    """The names in a file's first record, which may go over several lines if they are quoted."""
    told = {name.lower(): value for name, value in options.items()}
    encoding = told.get("encoding", told.get("charset", "utf-8"))
    start = files.head(spark, path, HEADER_BYTES).decode(encoding, errors="replace")
    lines = io.StringIO(start.removeprefix("\ufeff"), newline="")
    quote = told.get("quote", '"')
    how = {"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE}
    delimiter = told.get("sep", told.get("delimiter", ",")).replace("\\t", "\t")
    if len(delimiter) != 1:
        return tuple(start.splitlines()[:1])
    return tuple(next((x for x in csv.reader(lines, delimiter=delimiter, **how) if x), ()))


def files_by_header(
    spark: SparkSession, paths: Sequence[str], options: Mapping[str, str] | None = None
) -> dict[tuple[tuple[str, ...], str], list[str]]:
    """The CSV files of all paths by their header (and by the folder that partition folders start
    from). Of a file its beginning is read, of many files side by side; a file without a
    line is left out."""
    found = [f for path in paths for f in files.data_files(spark, path)]
    with ThreadPoolExecutor(HEADERS_TOGETHER) as pool:
        headers = pool.map(lambda f: _header(spark, f[0], options or {}), found)
        groups: dict[tuple[tuple[str, ...], str], list[str]] = {}
        for (path, base), header in zip(found, headers, strict=True):
            if header:
                groups.setdefault((header, base), []).append(path)
    return groups


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    required: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
    corrupt_column: str | None = None,
) -> DataFrame:
    """CSV with headers: columns go by name, all are strings, extra ones are kept.

    Files may differ in their headers, also within a folder: there is one scan for all files
    of a header, and the scans are put together by name, with NULL where one lacks a column.
    ``options`` go to Spark's reader (delimiter, quote, ...); ``corrupt_column`` names a
    column that takes the whole line where a row does not fit the header.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)

    def one(base: str, found: Sequence[str]) -> DataFrame:
        how = dict(options or {}) | {"header": "true", "enforceSchema": "false"}
        if base:
            how["basePath"] = base
        plain = [files.literal(f) for f in found]
        # The names as Spark makes them, from one file; the others have the same header.
        schema = spark.read.options(**how).csv(plain[0]).schema
        if corrupt_column is not None:
            # Spark fills such a column only if the schema names it, by position at the end.
            schema = schema.add(corrupt_column, "string")
            how["columnNameOfCorruptRecord"] = corrupt_column
        return spark.read.options(**how).schema(schema).csv(plain)

    groups = files_by_header(spark, paths, options)
    if not groups:
        raise ValueError(f"no CSV file with a header in {', '.join(paths)}")
    each = [one(base, found) for (_, base), found in groups.items()]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    return require_columns(df, required, ", ".join(paths))


def jdbc_read_options(
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
    single_task: bool = False,
    options: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options; a partition column makes executors read ranges of it side by side.

    The bounds only place the cuts: rows outside them are still read. Without them one task
    reads the whole table, which must be asked for by ``single_task``.
    """
    if single_task == (partition_column is not None):
        raise ValueError("give a partition column, or single_task=True for a small table")
    split = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(v is None for v in split) and any(v is not None for v in split):
        raise ValueError("a partitioned read needs column, both bounds and num_partitions")
    result = {"url": url, "dbtable": table, "fetchsize": str(JDBC_BATCH_ROWS)}
    if partition_column is not None:
        result |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower_bound),
            "upperBound": str(upper_bound),
            "numPartitions": str(num_partitions),
        }
    return result | dict(options or {})


def cuts_query(table: str, column: str, parts: int) -> str:
    """SQL for the source: the least value of each of ``parts`` runs of about as many rows in
    the column's order. By NTILE, which SQLite and PostgreSQL know among others."""
    return (
        f"SELECT MIN(cut_value) AS cut_value FROM (SELECT {column} AS cut_value, "
        f"NTILE({parts}) OVER (ORDER BY {column}) AS cut_part FROM {table} "
        f"WHERE {column} IS NOT NULL) cut_runs GROUP BY cut_part"
    )


def _literal(value: object) -> str:
    if isinstance(value, bool) or not isinstance(value, int | float | Decimal | str | date):
        raise ValueError(f"cannot cut a table at {value!r}")
    if isinstance(value, int | float | Decimal):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def range_predicates(column: str, cuts: Sequence[object]) -> list[str]:
    """Conditions that each row of a table meets one of, with NULL in the first. A value that
    fills several runs is one cut, and so one range of its own."""
    known = sorted(set(cuts))[1:]
    if not known:
        return ["1 = 1"]
    shown = [_literal(c) for c in known]
    first = f"{column} < {shown[0]} OR {column} IS NULL"
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in pairwise(shown)]
    return [first, *inner, f"{column} >= {shown[-1]}"]


def read_jdbc_balanced(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    num_partitions: int,
    required: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table in ranges of about as many rows each, whatever the spread of ``column``.

    The source is asked for the cuts first, one number per range; bounds need not be known and
    gaps or dense stretches of ids make no task longer than the others.
    """
    asked = spark.read.format("jdbc").options(
        **{"url": url, "query": cuts_query(table, column, num_partitions)} | dict(options or {})
    )
    cuts = [r[0] for r in asked.load().collect() if r[0] is not None]
    properties = {"fetchsize": str(JDBC_BATCH_ROWS)} | dict(options or {})
    predicates = range_predicates(column, cuts)
    df = spark.read.jdbc(url, table, predicates=predicates, properties=properties)
    return require_columns(df, required, table)


def read_jdbc(
    spark: SparkSession, url: str, table: str, required: Sequence[str] = (), **how
) -> DataFrame:
    """A database table in its own types; see ``jdbc_read_options`` for ``how``."""
    reader = spark.read.format("jdbc").options(**jdbc_read_options(url, table, **how))
    return require_columns(reader.load(), required, table)


def jdbc_write_options(
    url: str,
    table: str,
    *,
    num_partitions: int = 8,
    truncate: bool = True,
    options: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Writer options. ``num_partitions`` bounds the connections opened at once;
    ``truncate`` keeps the table, its grants and indexes when it is overwritten."""
    return {
        "url": url,
        "dbtable": table,
        "batchsize": str(JDBC_BATCH_ROWS),
        "numPartitions": str(num_partitions),
        "truncate": str(truncate).lower(),
    } | dict(options or {})


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite", **how) -> None:
    """Save to a database table; see ``jdbc_write_options`` for ``how``.

    Spark narrows the frame itself to the number of connections, so hand over a stored one
    (``jobs.jdbc_sink`` does), or its last joins and sums run in as few tasks.
    """
    df.write.format("jdbc").options(**jdbc_write_options(url, table, **how)).mode(mode).save()


STAGED = "__new"


def switch_statements(schema: str, tables: Sequence[str]) -> list[str]:
    """SQL that moves the rows of staged tables into those that readers see, to be run in one
    transaction. Tables that are there keep their grants and indexes; new ones are made."""
    found: list[str] = []
    for table in tables:
        name, staged = f"{schema}.{table}", f"{schema}.{table}{STAGED}"
        found += [
            f"CREATE TABLE IF NOT EXISTS {name} AS SELECT * FROM {staged} WHERE 1 = 0",
            f"DELETE FROM {name}",
            f"INSERT INTO {name} SELECT * FROM {staged}",
        ]
    return found + [f"DROP TABLE {schema}.{table}{STAGED}" for table in tables]


def run_in_transaction(
    spark: SparkSession,
    url: str,
    statements: Sequence[str],
    options: Mapping[str, str] | None = None,
) -> None:
    """Run SQL in a database through a connection of the driver's: all of it or, if a
    statement fails, none."""
    told = dict(options or {})
    jvm = spark._jvm
    if driver := told.pop("driver", None):
        jvm.java.lang.Class.forName(driver)
    properties = jvm.java.util.Properties()
    for name, value in told.items():
        properties.setProperty(name, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            for text in statements:
                statement.execute(text)
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
    finally:
        connection.close()
