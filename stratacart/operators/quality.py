"""Row rules: NULL keys, value ranges, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"


def require_key(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows where any key is NULL."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def require_positive(df: DataFrame, *names: str, reject_nan: bool = False) -> DataFrame:
    """Keep rows where every named column is > 0. NULL fails; NaN passes unless rejected."""
    for name in names:
        df = df.where(F.col(name) > 0)
        if reject_nan:
            df = df.where(~F.isnan(name))
    return df


def require_between(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    """Keep rows where ``low <= name <= high``; NULL fails."""
    return df.where(F.col(name).between(low, high))


def dedup_by_key(
    df: DataFrame, keys: str | Sequence[str], order_by: Sequence[Column] = ()
) -> DataFrame:
    """One row per key, NULL counting as a key: the first by ``order_by``, then by all
    other columns ascending with NULLs first, so reruns keep the same row.

    Catalyst turns the rank filter into a group limit on both sides of the shuffle:
    each map task sends at most one row per key, so a hot key costs no more than others.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [*order_by, *(F.col(c).asc_nulls_first() for c in df.columns if c not in keys)]
    if not order:
        return df.distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(_RANK, rank).where(F.col(_RANK) == 1).drop(_RANK)


def distinct_values(df: DataFrame, name: str, alias: str | None = None) -> DataFrame:
    """The distinct values of one column, NULL included."""
    return df.select(F.col(name).alias(alias or name)).distinct()
