"""Silver tables in the session's catalog, as external tables over their Parquet folders.

A partition is a day, and its location the folder of the run that the day's records name.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacart.schemas import (
    GOLD_INPUTS,
    KEY,
    SILVER,
    SILVER_PARTITION,
    columns,
    ddl,
    spark_type,
)
from stratacart.sources import lake
from stratacart.sources.lake import ALL, Snapshot

log = logging.getLogger(__name__)

#: Table property with the time stamp of the newest record that the partitions follow.
_FOLLOWED = "stratacart.followed"
#: Records this much older than that are looked at again, as drivers' clocks differ.
_CLOCKS = timedelta(days=1)
#: Partitions added by one statement.
_TOGETHER = 200


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    """Create a database unless it exists; its own tables go to ``location``, or else to
    the session's warehouse folder."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{place}")


def use_database(spark: SparkSession, database: str) -> None:
    spark.catalog.setCurrentDatabase(database)


def drop_table(spark: SparkSession, database: str, table: str) -> None:
    """Forget an external table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{table}`")


@dataclass(frozen=True)
class Declared:
    """What the catalog says of a table."""

    columns: tuple[tuple[str, str], ...]
    partition: tuple[str, ...]
    kind: str
    provider: str
    location: str


def declared(spark: SparkSession, database: str, table: str) -> Declared | None:
    if not spark.catalog.tableExists(f"`{database}`.`{table}`"):
        return None
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{table}`").collect()
    names = [r["col_name"] for r in rows]
    end = next((n for n, name in enumerate(names) if not name or name.startswith("#")), len(rows))
    parts: list[str] = []
    if "# Partition Information" in names:
        for name in names[names.index("# Partition Information") + 2 :]:
            if not name or name.startswith("#"):
                break
            parts.append(name)
    told = {r["col_name"]: r["data_type"] for r in rows[end:]}
    fields = [(r["col_name"], r["data_type"]) for r in rows[:end] if r["col_name"] not in parts]
    return Declared(
        tuple(fields),
        tuple(parts),
        told.get("Type", ""),
        told.get("Provider", "").lower(),
        told.get("Location", "").rstrip("/"),
    )


def _same_place(spark: SparkSession, one: str, other: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()

    def whole(text: str) -> str:
        folder = path(text)
        return folder.getFileSystem(conf).makeQualified(folder).toString()

    return whole(one) == whole(other)


def register_table(
    spark: SparkSession, database: str, table: str, root: str, key_type: str = "bigint"
) -> None:
    """Declare a silver table over its folder; partitions show up after a repair.

    An older declaration is brought up to date. New columns at the end are added to it. One
    with other types or partitions, or over another folder, is made anew: the files of an
    external table stay, and the next repair finds its partitions again. What is not an
    external table, such as a view or a table that owns its files, is left alone, and named
    in the error.
    """
    wanted = tuple((n, spark_type(kind, key_type)) for n, kind in SILVER[table])
    place = f"{root.rstrip('/')}/{table}"
    old = declared(spark, database, table)
    if old is not None:
        if old.kind != "EXTERNAL" or old.provider != "parquet":
            what = f"{old.kind.lower()} {old.provider}".strip()
            raise ValueError(f"{database}.{table} is no external Parquet table but: {what}")
        same = old.partition == SILVER_PARTITION and _same_place(spark, old.location, place)
        if same and old.columns == wanted:
            return
        if same and wanted[: len(old.columns)] == old.columns:
            more = ", ".join(f"`{n}` {kind}" for n, kind in wanted[len(old.columns) :])
            spark.sql(f"ALTER TABLE `{database}`.`{table}` ADD COLUMNS ({more})")
            return
        log.info("declaring %s.%s anew, it was %s", database, table, old)
        drop_table(spark, database, table)
    partition = ", ".join(f"{name} INT" for name in SILVER_PARTITION)
    spark.sql(
        f"CREATE TABLE `{database}`.`{table}` "
        f"({ddl(SILVER[table], key_type)}, {partition}) USING parquet "
        f"PARTITIONED BY ({', '.join(SILVER_PARTITION)}) LOCATION '{place}'"
    )


def _spec(day: date) -> str:
    values = zip(SILVER_PARTITION, (day.year, day.month, day.day), strict=True)
    return f"PARTITION ({', '.join(f'{n} = {v}' for n, v in values)})"


def _day_of(partition: str) -> date:
    values = dict(x.split("=") for x in partition.split("/"))
    return date(*(int(values[n]) for n in SILVER_PARTITION))


def _followed(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").where(F.col("key") == _FOLLOWED).head()
    return rows["value"] if rows else ""


def repair_partitions(spark: SparkSession, database: str, table: str) -> list[date]:
    """Bring the partitions up to the records below the table's folder; returns the days that
    were looked at.

    Only days with records newer than those already followed are touched, by statements to
    the catalog alone: no table folder is listed, however many days there are.
    """
    name = f"`{database}`.`{table}`"
    root = silver_root(spark, database, table)
    records = lake.record_names(spark, root)
    followed = _followed(spark, name)
    since = ""
    if followed:
        last = datetime.strptime(followed.partition("-")[0], "%Y%m%dT%H%M%S%f")
        since = f"{last - _CLOCKS:%Y%m%dT%H%M%S%f}"
    days = sorted({r.day for r in records if r.stamp >= since})
    if not days:
        return []
    state = {d: lake.day_state(spark, root, d).runs.get(table) for d in days}
    state = {d: run for d, run in state.items() if run is not None}
    shown = {_day_of(r[0]) for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    fresh = [d for d in state if d not in shown]
    for start in range(0, len(fresh), _TOGETHER):
        added = " ".join(
            f"{_spec(d)} LOCATION '{lake.run_path(root, table, d, state[d])}'"
            for d in fresh[start : start + _TOGETHER]
        )
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {added}")
    for day in (d for d in state if d in shown):
        place = lake.run_path(root, table, day, state[day])
        spark.sql(f"ALTER TABLE {name} {_spec(day)} SET LOCATION '{place}'")
    newest = max(r.stamp for r in records)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{_FOLLOWED}' = '{newest}')")
    return list(state)


def register_silver(
    spark: SparkSession, database: str, root: str, key_type: str = "bigint"
) -> None:
    """Declare all six silver tables and bring their partitions up to date."""
    create_database(spark, database)
    for table in SILVER:
        register_table(spark, database, table, root, key_type)
        repair_partitions(spark, database, table)


def silver_root(spark: SparkSession, database: str, table: str) -> str:
    """The folder that holds the table's folder."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{table}`")
    location = described.where("col_name = 'Location'").select("data_type").head()[0]
    return location.rstrip("/").rpartition("/")[0]


def latest_snapshot(spark: SparkSession, database: str, tables=GOLD_INPUTS) -> date:
    """The newest day that a run has recorded as finished below the tables' folder."""
    return lake.latest_snapshot(spark, silver_root(spark, database, tables[0]), tables)


def key_type_of(spark: SparkSession, database: str, table: str) -> str:
    """The type that the table declares for identifiers."""
    kinds = dict(spark.table(f"`{database}`.`{table}`").dtypes)
    keys = [n for n, kind in SILVER[table] if kind == KEY]
    return kinds[keys[0]] if keys else "bigint"


def read_pinned(spark: SparkSession, database: str, table: str, pinned) -> DataFrame:
    """A silver table of a snapshot that ``lake.pin`` has settled.

    Which days those are comes from the records, their files from the partitions.
    """
    df = spark.table(f"`{database}`.`{table}`")
    if isinstance(pinned, list):
        return df.select(*columns(SILVER[table]))
    if isinstance(pinned, tuple):
        days = [r.day for r in pinned]
        return lake.newest_per_key(df.where(F.make_date(*SILVER_PARTITION).isin(days)), table)
    day = pinned.day
    for name, value in zip(SILVER_PARTITION, (day.year, day.month, day.day), strict=True):
        df = df.where(F.col(name) == value)
    return df.select(*columns(SILVER[table]))


def read_table(
    spark: SparkSession, database: str, table: str, snapshot: Snapshot = lake.LATEST
) -> DataFrame:
    """A silver table as of one ingest date (only that partition is read), of all dates, or
    with the newest row of each key."""
    if snapshot == ALL:
        pinned = []
    else:
        pinned = lake.pin(spark, silver_root(spark, database, table), snapshot, [table])
    return read_pinned(spark, database, table, pinned)
