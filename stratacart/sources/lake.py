"""Date-partitioned Parquet tables: one folder per table, one leaf per ingest date.

Bronze leaves hold files. Silver leaves hold a folder per run, and small records beside the
tables say which run is the one of a day:

    silver/fact_orders/ingest_year=2024/ingest_month=1/ingest_day=31/run-20240201T0312.../
    silver/_days/2024-01-31_20240201T0340....json

A run writes new folders only. One record, renamed into place, then points the day at all of
them at once, so that a reader sees the day as it was before or as it is after, and a run that
fails has changed nothing. Records are never rewritten: those of a day are folded in the order
of their time stamps. The run before stays for those that still read it.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacart.operators.joins import bounded
from stratacart.operators.quality import dedup_by_key
from stratacart.schemas import (
    BRONZE_PARTITION,
    GOLD_INPUTS,
    SILVER,
    SILVER_KEYS,
    SILVER_PARTITION,
    columns,
    ddl,
)
from stratacart.sources import files

log = logging.getLogger(__name__)

#: Folder of a silver root with the records; readers of tables pass it over.
_RECORDS = "_days"
#: How often a reader looks again when a record it was about to read has been cleared away.
_LOOKS = 5

WRITE_MODES = ("overwrite", "append")

#: Of the files of both layers. Ids and amounts as text take three fifths of what Spark's
#: default makes of them, in the same time.
_CODEC = "zstd"

LATEST = "latest"
ALL = "all"


def _parts(names: Sequence[str], day: date) -> dict[str, int]:
    return dict(zip(names, (day.year, day.month, day.day), strict=True))


def leaf_path(root: str, table: str, names: Sequence[str], day: date) -> str:
    folders = "/".join(f"{name}={value}" for name, value in _parts(names, day).items())
    return f"{root.rstrip('/')}/{table}/{folders}"


def run_path(root: str, table: str, day: date, run: str) -> str:
    """The folder of one run of a day of a silver table."""
    return f"{leaf_path(root, table, SILVER_PARTITION, day)}/{run}"


def tag_ingest_date(df: DataFrame, names: Sequence[str], day: date) -> DataFrame:
    """Add the three constant partition columns."""
    return df.withColumns({n: F.lit(v) for n, v in _parts(names, day).items()})


def _check_mode(mode: str) -> None:
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}, not {mode!r}")


def write_bronze(
    df: DataFrame, root: str, table: str, day: date, mode: str = "overwrite"
) -> None:
    """Write one day of a raw table.

    Overwriting replaces that day only, and only when the job commits, so a rerun gives
    the same table and a failed run leaves the old day. Spark replaces a partition by
    the rows that go into it; a result without rows is therefore written to the leaf.
    """
    _check_mode(mode)
    spark = df.sparkSession
    leaf = leaf_path(root, table, BRONZE_PARTITION, day)
    old_file = files.any_file(spark, leaf) if mode == "overwrite" else None
    (
        tag_ingest_date(df, BRONZE_PARTITION, day)
        .write.partitionBy(*BRONZE_PARTITION)
        .mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", _CODEC)
        .parquet(f"{root.rstrip('/')}/{table}")
    )
    kept_old = old_file is not None and files.exists(spark, old_file)
    if kept_old or not files.exists(spark, leaf):
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(leaf)
    log.info("wrote %s", leaf)


def read_bronze(spark: SparkSession, root: str, table: str, day: date) -> DataFrame:
    """One day of a raw table, without the partition columns.

    Only that day's leaf is listed and only its files decide the columns.
    """
    return spark.read.parquet(leaf_path(root, table, BRONZE_PARTITION, day))


# What the records say.


@dataclass(frozen=True)
class DayRecord:
    """The state of a day.

    ``runs`` names the run of each table that was written; ``tables`` those that a finished job
    vouches for, with ``unique_ids`` if no id of a fact repeats in them. ``full`` tells an
    extract of everything from one of what changed, and ``counts`` has what the quality rules
    of each table let through. ``rows`` says how many rows a run has, where its job counted them.
    """

    day: date
    runs: Mapping[str, str] = field(default_factory=dict)
    tables: tuple[str, ...] = ()
    unique_ids: bool = False
    full: bool = True
    counts: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    rows: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class AsOf:
    """Of each key the row of its newest ingest date up to ``day``, or up to the newest
    finished day: the snapshot that extracts of changes add up to."""

    day: date | None = None


Snapshot = date | str | DayRecord | AsOf


def _stamp() -> str:
    return f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid4().hex[:8]}"


def new_run() -> str:
    return f"run-{_stamp()}"


@dataclass(frozen=True, order=True)
class RecordName:
    day: date
    stamp: str

    @property
    def file(self) -> str:
        return f"{self.day.isoformat()}_{self.stamp}.json"


def record_names(spark: SparkSession, root: str) -> list[RecordName]:
    """All records by day and time, from one listing."""
    names = files.child_files(spark, f"{root.rstrip('/')}/{_RECORDS}")
    split = (n.removesuffix(".json").partition("_") for n in names if not n.startswith("."))
    return sorted(RecordName(date.fromisoformat(day), stamp) for day, _, stamp in split)


def _contents(spark: SparkSession, root: str, name: RecordName) -> dict:
    path = f"{root.rstrip('/')}/{_RECORDS}/{name.file}"
    try:
        found = json.loads(files.read_bytes(spark, path))
    except ValueError as error:
        raise ValueError(f"{path} is no record of a day") from error
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no record of a day")
    return found


def _folded(day: date, records: Iterable[Mapping]) -> DayRecord:
    runs, said = {}, {"tables": (), "unique_ids": False, "full": True, "counts": {}}
    rows: dict[str, int] = {}
    for record in records:
        new = record.get("runs", {})
        # Rows are those of a run; one that does not tell has none of the run before.
        rows = {t: n for t, n in rows.items() if t not in new} | record.get("rows", {})
        runs |= new
        said |= {k: record[k] for k in said if k in record}
    return DayRecord(day, runs, **(said | {"tables": tuple(said["tables"])}), rows=rows)


def _records_of(spark: SparkSession, root: str, day: date) -> list[tuple[RecordName, dict]]:
    """The records of a day in order. Those that a later one made superfluous may be cleared
    away between the listing and the reading; then both are done again."""
    for look in range(_LOOKS):
        names = [n for n in record_names(spark, root) if n.day == day]
        try:
            return [(n, _contents(spark, root, n)) for n in names]
        except Exception:
            if look == _LOOKS - 1 or all(
                files.exists(spark, f"{root.rstrip('/')}/{_RECORDS}/{n.file}") for n in names
            ):
                raise
    raise AssertionError("unreachable")


def day_state(spark: SparkSession, root: str, day: date) -> DayRecord:
    """What is recorded of a day, finished or not."""
    return _folded(day, (r for _, r in _records_of(spark, root, day)))


def day_record(spark: SparkSession, root: str, day: date) -> DayRecord | None:
    """The state of a day that a job has finished, else None."""
    state = day_state(spark, root, day)
    return state if state.tables else None


def history(spark: SparkSession, root: str, until: date | None = None) -> list[DayRecord]:
    """The states of all days up to ``until``, read by one job however many there are."""
    path = f"{root.rstrip('/')}/{_RECORDS}"
    if not files.child_files(spark, path):
        return []
    lines = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name"))
    found: dict[date, list[tuple[str, dict]]] = {}
    for line in lines.collect():
        day, _, stamp = line["file_name"].removesuffix(".json").partition("_")
        record = (stamp, json.loads(line["value"]))
        found.setdefault(date.fromisoformat(day), []).append(record)
    return [
        _folded(day, (r for _, r in sorted(records, key=lambda x: x[0])))
        for day, records in sorted(found.items())
        if until is None or day <= until
    ]


# Writing a day.


def stage_silver(
    df: DataFrame, root: str, table: str, day: date, run: str, deal: bool = True
) -> None:
    """Write a table of a day into the folder of ``run``, which no reader looks at before
    ``commit_day``. Rows are dealt out evenly, so that files come out near
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, neither tiny nor one per hot key.

    Dealing shuffles the table once more. ``deal=False`` leaves that out, for a frame that ends
    in a shuffle, whose parts adaptive execution has brought to that size and split if a join's
    key is hot, or that is read from files of good size.
    """
    path = run_path(root, table, day, run)
    df = df.hint("rebalance") if deal else df
    df.write.mode("errorifexists").option("compression", _CODEC).parquet(path)
    log.info("wrote %s", path)


def read_staged(
    spark: SparkSession, root: str, table: str, day: date, run: str, key_type: str = "bigint"
) -> DataFrame:
    path = run_path(root, table, day, run)
    return spark.read.schema(ddl(SILVER[table], key_type)).parquet(path)


def drop_staged(
    spark: SparkSession, root: str, day: date, run: str, tables: Iterable[str] = tuple(SILVER)
) -> None:
    """Delete what a run has written that will not be committed."""
    for table in tables:
        files.delete(spark, run_path(root, table, day, run))


def commit_day(
    spark: SparkSession, root: str, day: date, runs: Mapping[str, str] | None = None, **said
) -> None:
    """Point the day at the runs of the named tables, and record what is ``said`` of it (fields
    of ``DayRecord``): all of it at once.

    Of each table the run before stays for those that still read it. Older ones are deleted,
    and so are records that later ones make superfluous.
    """
    earlier = _records_of(spark, root, day)
    name = RecordName(day, _stamp())
    record = {"runs": dict(runs or {})} | said
    data = json.dumps(record, sort_keys=True).encode()
    files.write_bytes(spark, f"{root.rstrip('/')}/{_RECORDS}/{name.file}", data)
    log.info("recorded %s in %s", day, root)
    if not runs:
        return
    told: dict[str, list[str]] = {}
    for one in [*(r for _, r in earlier), record]:
        for table, run in one.get("runs", {}).items():
            told.setdefault(table, []).append(run)
    for table, known in told.items():
        for run in dict.fromkeys(known[:-2]):
            if run not in known[-2:]:
                files.delete(spark, run_path(root, table, day, run))
    # What comes before a record that says everything is no longer needed.
    whole = [
        n
        for n, (_, r) in enumerate(earlier)
        if "tables" in r and set(told) <= set(r.get("runs", ()))
    ]
    for old, _ in earlier[: whole[-1] if whole else 0]:
        files.delete(spark, f"{root.rstrip('/')}/{_RECORDS}/{old.file}")


def write_silver(
    df: DataFrame,
    root: str,
    table: str,
    day: date,
    mode: str = "overwrite",
    deal: bool = True,
) -> None:
    """Write one day of a silver table and point the day at it.

    ``append`` writes the day's present rows once more together with the new ones, so that a
    reader has the old day or the new one. ``deal`` is that of ``stage_silver``.
    """
    _check_mode(mode)
    spark = df.sparkSession
    before = day_state(spark, root, day).runs.get(table)
    if mode == "append" and before is not None:
        old = spark.read.parquet(run_path(root, table, day, before))
        df = old.unionByName(df)
    run = new_run()
    stage_silver(df, root, table, day, run, deal)
    commit_day(spark, root, day, {table: run})


def begin_day(spark: SparkSession, root: str, day: date) -> None:
    """Take back the word for ``day``: until ``complete_day`` no snapshot is of it."""
    commit_day(spark, root, day, tables=[])


def complete_day(
    spark: SparkSession, root: str, day: date, tables: Sequence[str], unique_ids: bool = False
) -> None:
    """Record that ``day`` has all its tables, as they are now."""
    commit_day(spark, root, day, tables=list(tables), unique_ids=unique_ids)


# Reading days.


def latest_record(
    spark: SparkSession, root: str, tables: Sequence[str] = GOLD_INPUTS
) -> DayRecord:
    """The newest day that a job has finished with all the tables. Folders do not count."""
    days = {n.day for n in record_names(spark, root)}
    for day in sorted(days, reverse=True):
        record = day_record(spark, root, day)
        if record is not None and set(tables) <= set(record.tables):
            return record
    raise ValueError(f"no ingest date is complete in {root} for {', '.join(tables)}")


def latest_snapshot(
    spark: SparkSession, root: str, tables: Sequence[str] = GOLD_INPUTS
) -> date:
    return latest_record(spark, root, tables).day


def as_record(
    spark: SparkSession, root: str, snapshot: Snapshot, tables: Sequence[str] = GOLD_INPUTS
) -> DayRecord:
    """The record of one day, however it is named. Reading several tables by one record gives
    them as of one run, whatever is committed meanwhile."""
    if isinstance(snapshot, DayRecord):
        return snapshot
    if snapshot == LATEST:
        return latest_record(spark, root, tables)
    return day_state(spark, root, as_day(snapshot))


def _run_of(record: DayRecord, root: str, table: str) -> str:
    if table not in record.runs:
        raise ValueError(f"{root} has no {table} of {record.day}")
    return record.runs[table]


def read_runs(
    spark: SparkSession, root: str, table: str, runs: Mapping[date, str], key_type: str = "bigint"
) -> DataFrame:
    """Several days of a table in one scan, with the three columns of the ingest date."""
    fields = SILVER[table]
    date_fields = ", ".join(f"{n} int" for n in SILVER_PARTITION)
    if not runs:
        return spark.createDataFrame([], f"{ddl(fields, key_type)}, {date_fields}")
    paths = [run_path(root, table, day, run) for day, run in sorted(runs.items())]
    reader = spark.read.schema(f"{ddl(fields, key_type)}, {date_fields}")
    return reader.option("basePath", f"{root.rstrip('/')}/{table}").parquet(*paths)


def newest_per_key(df: DataFrame, table: str) -> DataFrame:
    """Of rows with ingest dates the newest of each key, without the date.

    NULL is one key. Each task sends a row per key at most to the shuffle, so that a history
    of many days costs no more there than its keys.
    """
    newest = [F.col(n).desc() for n in SILVER_PARTITION]
    return dedup_by_key(df, SILVER_KEYS[table], newest).select(*columns(SILVER[table]))


def _days_as_of(
    spark: SparkSession, root: str, tables: Sequence[str], until: date | None
) -> list[DayRecord]:
    """The finished days that a snapshot is made of: from the last full one on."""
    days = [r for r in history(spark, root, until) if set(tables) <= set(r.tables)]
    start = max((n for n, r in enumerate(days) if r.full), default=0)
    return days[start:]


def read_with_changes(
    spark: SparkSession,
    root: str,
    table: str,
    day: date,
    run: str,
    key_type: str = "bigint",
    rows: int | None = None,
) -> DataFrame:
    """What a table will be once ``run``, of so many ``rows``, is committed as the changes of
    ``day``; for a join with its children (see ``joins.bounded``)."""
    earlier = [r for r in _days_as_of(spark, root, [table], day) if r.day < day]
    runs = {r.day: _run_of(r, root, table) for r in earlier} | {day: run}
    df = newest_per_key(read_runs(spark, root, table, runs, key_type), table)
    before = known_rows(earlier, table)
    return bounded(df, None if rows is None or before is None else before + rows)


def pin(spark: SparkSession, root: str, snapshot: Snapshot, tables: Sequence[str] = GOLD_INPUTS):
    """A snapshot as what ``read_pinned`` takes: a record, or records, that later commits do
    not change."""
    if snapshot == ALL:
        return [r for r in history(spark, root) if r.runs]
    if isinstance(snapshot, AsOf):
        found = _days_as_of(spark, root, tables, snapshot.day)
        if not found:
            raise ValueError(f"no ingest date is complete in {root} for {', '.join(tables)}")
        return tuple(found)
    return as_record(spark, root, snapshot, tables)


def read_pinned(
    spark: SparkSession, root: str, table: str, pinned, key_type: str = "bigint"
) -> DataFrame:
    """A table of a pinned snapshot: one day, the newest rows of a tuple of days, or all rows
    of a list of days."""
    fields = SILVER[table]
    if isinstance(pinned, DayRecord):
        run = _run_of(pinned, root, table)
        return read_staged(spark, root, table, pinned.day, run, key_type)
    if isinstance(pinned, tuple):
        runs = {r.day: _run_of(r, root, table) for r in pinned}
        return newest_per_key(read_runs(spark, root, table, runs, key_type), table)
    runs = {r.day: r.runs[table] for r in pinned if table in r.runs}
    return read_runs(spark, root, table, runs, key_type).select(*columns(fields))


def known_rows(pinned, table: str) -> int | None:
    """How many rows a table of a pinned snapshot has at most, if the records tell of all days."""
    records = [pinned] if isinstance(pinned, DayRecord) else pinned
    found = [r.rows.get(table) for r in records if table in r.runs]
    return None if None in found else sum(found)


def read_silver(
    spark: SparkSession,
    root: str,
    table: str,
    snapshot: Snapshot = LATEST,
    key_type: str = "bigint",
) -> DataFrame:
    """A silver table as of one ingest date, of all dates one after another, or with the newest
    row of each key (``AsOf``).

    The declared schema saves reading footers; only the folders of the runs are listed.
    """
    pinned = pin(spark, root, snapshot, [table])
    return read_pinned(spark, root, table, pinned, key_type)


def as_day(snapshot: Snapshot) -> date:
    if not isinstance(snapshot, date):
        raise ValueError(f"snapshot must be a date, {LATEST!r} or {ALL!r}, not {snapshot!r}")
    return snapshot
