"""Intermediate tables in the folder the cluster shares, for plans that must not be
computed twice or must survive the loss of executors.

They are deleted when they are discarded, or else when the application ends.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession

from stratacart.sources import files


log = logging.getLogger(__name__)


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder in the session's warehouse if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        log.warning(
            "spark.checkpoint.dir is unset: intermediate tables go below the warehouse, "
            "%s, which all executors must share",
            spark.conf.get("spark.sql.warehouse.dir"),
        )
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, name: str, root: str | None = None) -> str:
    """A fresh folder name below ``root``, which all executors must share."""
    return f"{(root or scratch_root(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, root: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to a scratch folder and read it back: the frame and its folder."""
    spark = df.sparkSession
    path = scratch_path(spark, name, root)
    df.write.parquet(path)
    files.delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``materialize``."""
    files.delete(spark, path)
