"""Run a registered query and its SQL, and compare the rows regardless of order."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _rows(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(spark: SparkSession, connection, sf_dir: str, query, sql: str) -> str:
    """Empty if both agree, else a description of the first differing rows."""
    result = query(spark, sf_dir)
    ours = _rows(result.columns, [tuple(r) for r in result.collect()])
    expected = connection.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(result.columns):
        return f"columns {sorted(result.columns)} against {sorted(names)}"
    theirs = _rows(names, expected.fetchall())
    extra, missing = ours - theirs, theirs - ours
    if extra or missing:
        return f"{sorted(names)}: extra {list(extra)[:3]}, missing {list(missing)[:3]}"
    return "" if ours else "no rows"
