"""Equi-joins of a fact with a table that has one row per key.

No join strategy is requested unless rows are copied or a parent is ``bounded``: Catalyst broadcasts a
side whose size it knows to be small and sort-merges otherwise, and AQE splits a foreign key that holds
many rows.

``salt`` adds a second join column, a hash of the whole row modulo ``salt``, against
``salt`` copies of each parent key:

* 1, the default for facts, copies nothing. It makes both sides shuffle for this join,
  without which AQE cannot split a hot key; a parent fresh from its deduplication is
  already laid out by the key and would pull the fact into that layout.
* More spreads every key over that many tasks, for sessions without AQE. Both sides are then
  shuffled and merged whatever Spark takes the parent's size for: its estimate knows nothing of
  the copies, and a parent that it would broadcast would go through the driver ``salt`` times.
* None joins on the key alone, for a child that has few rows per key.

Unlike a random number, the hash is the same when a lost task runs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT = "__salt"

#: Rows up to which the broadcast of a stored parent is left to Spark. Hashed, a row with little
#: but its key takes some 110 bytes of the driver.
BROADCAST_ROWS = 1 << 19


def bounded(parent: DataFrame, rows: int | None) -> DataFrame:
    """``parent``, to be shuffled and merged by a join unless it is known to have few rows.

    Spark takes a table for as large as its share of the bytes of its files, and ten megabytes
    of packed keys are millions of rows, which a broadcast would hash in the driver.
    """
    return parent if rows is not None and rows <= BROADCAST_ROWS else parent.hint("merge")


def _join(
    child: DataFrame, parent: DataFrame, key: str, how: str, salt: int | None
) -> DataFrame:
    if salt is None:
        return child.join(parent, key, how)
    if salt < 1:
        raise ValueError("salt must be at least 1")
    # With one copy the hash decides nothing and is taken of the key alone.
    hashed = [key] if salt == 1 else child.columns
    spread = F.pmod(F.xxhash64(*hashed), F.lit(salt)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
    copied = parent.withColumn(_SALT, copies)
    if salt > 1:
        copied = copied.hint("merge")
    return child.withColumn(_SALT, spread).join(copied, [key, _SALT], how).drop(_SALT)


def fk_filter(
    child: DataFrame, parent: DataFrame, key: str, salt: int | None = 1
) -> DataFrame:
    """Rows of ``child`` whose key exists in ``parent``; never multiplies rows."""
    return _join(child, parent.select(key), key, "left_semi", salt).select(*child.columns)


def fk_enrich(
    child: DataFrame, parent: DataFrame, key: str, *names: str, salt: int | None = 1
) -> DataFrame:
    """Rows of ``child`` whose key exists in ``parent``, with the named parent columns."""
    joined = _join(child, parent.select(key, *names), key, "inner", salt)
    return joined.select(*child.columns, *names)


def left_enrich(
    child: DataFrame, parent: DataFrame, key: str, *names: str, salt: int | None = 1
) -> DataFrame:
    """All rows of ``child`` with the named parent columns, NULL where there is no match."""
    joined = _join(child, parent.select(key, *names), key, "left", salt)
    return joined.select(*child.columns, *names)
