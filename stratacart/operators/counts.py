"""Counts of the rows that quality rules drop, taken as the rows pass.

A count is an observed metric of Spark: it is computed by the tasks that write the table
anyway, and read when they are done. Nothing is scanned or shuffled for it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Points on a row's way: as read and cast, after the filters, after the duplicates are gone,
#: and as written.
IN, FILTERED, DISTINCT, OUT = "in", "filtered", "distinct", "out"

Counted = Callable[..., DataFrame]


def uncounted(df: DataFrame, point: str, also: Mapping[str, Column] | None = None) -> DataFrame:
    """In place of ``RowCounts`` where nobody asks."""
    return df


class RowCounts:
    """Counts at points of one table's plan; to be read once that is written."""

    def __init__(self) -> None:
        self._observed: dict[str, tuple[Observation, DataFrame]] = {}
        self._known: dict[str, dict[str, int]] = {}

    def __call__(
        self, df: DataFrame, point: str, also: Mapping[str, Column] | None = None
    ) -> DataFrame:
        """``df``, counted as it passes ``point``, with the number of rows that meet each of
        the further conditions."""
        observation = Observation()
        sums = [F.count_if(condition).alias(name) for name, condition in (also or {}).items()]
        sums = [F.count(F.lit(1)).alias("rows"), *sums]
        self._observed[point] = (observation, df.select(*sums))
        return df.observe(observation, *sums)

    def _told(self, point: str) -> dict[str, int]:
        """An adaptive plan that finds a join without rows drops what leads to it, the counts
        included. Only then are the rows counted by themselves."""
        if point not in self._known:
            observation, counted = self._observed[point]
            try:
                self._known[point] = dict(observation.get)
            except Py4JJavaError:
                self._known[point] = counted.head().asDict()
        return self._known[point]

    def rows(self, point: str) -> int:
        """How many rows passed ``point``."""
        return self._told(point)["rows"]

    def dropped(self) -> dict[str, int]:
        """How many rows came in and went out, what became of the others (``filtered``,
        ``duplicate`` or ``orphan``), and per column how many values could not be cast."""
        told = {point: dict(self._told(point)) for point in self._observed}
        rows = {point: t.pop("rows", 0) for point, t in told.items()}
        if set(rows) != {IN, FILTERED, DISTINCT, OUT}:
            return rows
        return {
            IN: rows[IN],
            "filtered": rows[IN] - rows[FILTERED],
            "duplicate": rows[FILTERED] - rows[DISTINCT],
            "orphan": rows[DISTINCT] - rows[OUT],
            OUT: rows[OUT],
        } | told[IN]
