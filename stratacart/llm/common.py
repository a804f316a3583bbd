"""Helpers that several of the text operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import AbstractContextManager, contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacart.sources.scratch import discard, materialize

MapBatches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

HOME = str(Path(__file__).resolve().parents[2])
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The characters \x20 and \x09 to \x0D.
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Let the session's Python workers import this package from where the driver has it, as
    well as from where they are started."""
    paths = spark.sparkContext.environment
    known = [x for x in paths.get("PYTHONPATH", "").split(":") if x]
    if HOME not in known:
        paths["PYTHONPATH"] = ":".join([*known, HOME])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: computed once, and there when an
    executor is lost."""
    return Steps(df.sparkSession).store(df, name)


#: Bytes of a batch that crosses to Python while a step is stored. By rows, as Spark counts
#: them by default, a batch of texts takes tens of megabytes on either side, for every task.
BATCH_BYTES = "4m"


@contextmanager
def set_while(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session that hold within the block."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


_MAX_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    return set_while(spark, {_MAX_BYTES: BATCH_BYTES})


def keep_batches_small(spark: SparkSession) -> None:
    """``small_batches`` from now on, for frames that are computed by whoever gets them. A size
    that the session has been given stays."""
    if spark.conf.get(_MAX_BYTES, None) is None:
        spark.conf.set(_MAX_BYTES, BATCH_BYTES)


class Steps:
    """Tables that the steps of a job hand on in the shared scratch folder. At the end of a
    ``with`` block they are deleted, so what is returned must not read them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folders: list[str] = []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Compute ``df`` and write it. What was shuffled for it is then of no more use, but
        Spark deletes shuffle files only when the driver happens to collect its garbage;
        asking for that keeps the disks of a long job to what one step needs."""
        with small_batches(self.spark):
            table, folder = materialize(df, f"llm-{name}")
        self.folders.append(folder)
        gc.collect()
        self.spark._jvm.System.gc()
        return table

    def drop(self) -> None:
        while self.folders:
            discard(self.spark, self.folders.pop())

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def give_back() -> None:
    """Return what this Python worker has freed to the system. Workers outlive their tasks, and
    without this the next stage's are added to what the last stage's once needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def thrifty(run: MapBatches) -> MapBatches:
    """A function for ``mapInArrow`` that gives memory back at its task's end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def quantiles(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values that cut the non-null values of an integer
    column into parts of about equal row counts. One number per part reaches the driver."""
    if parts < 2:
        return []
    steps = [i / parts for i in range(1, parts)]
    found = df.select(
        F.percentile_approx(column, steps, F.lit(max(10_000, 20 * parts))).alias("cuts")
    ).head()
    return sorted({int(x) for x in found["cuts"] or []})


def parts_of(values: pa.Array, cuts: np.ndarray, unknown: int = 0) -> pa.Array:
    """For each integer the number of ``cuts`` that are at most it; ``unknown`` for null."""
    known = np.asarray(values.is_valid())
    numbers = np.asarray(pc.fill_null(values, 0))
    places = np.searchsorted(cuts, numbers, side="right")
    return pa.array(np.where(known, places, unknown), type=pa.int32())


def part_of(column: Column, cuts: Sequence[int]) -> Column:
    """``parts_of`` as an expression."""
    bounds = np.asarray(cuts, dtype=np.int64)
    on_workers(SparkSession.active())

    @F.arrow_udf("int")
    def place(values: pa.Array) -> pa.Array:
        return parts_of(values, bounds)

    return place(column)


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``size`` bytes of ``column``, at least a row each, so
    that a batch of very long texts never lies in Python whole."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0))
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        below = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, below + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
