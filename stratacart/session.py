"""Sessions for applications.

Library functions take the caller's session or DataFrames and leave its settings
alone; ``open_session`` is for programs that have no session yet.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)

SHUFFLE_PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions_for(input_bytes: int, cores: int = 1) -> int:
    """Shuffle partitions for the largest table: enough that one fits in a task's
    memory, at least one per core. AQE merges those that come out small."""
    return max(math.ceil(input_bytes / SHUFFLE_PARTITION_BYTES), cores)


def open_session(
    app_name: str,
    shuffle_partitions: int | None = None,
    hive_metastore: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Get or create a session with the settings the jobs count on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if hive_metastore is not None:
        builder = builder.config("hive.metastore.uris", hive_metastore).enableHiveSupport()
    for name, value in (conf or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def skew_is_split(spark: SparkSession) -> bool:
    """Whether this session splits hot join keys at run time by itself."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(name) == "true" for name in names)


def warn_unless_skew_is_split(spark: SparkSession, salt: int) -> None:
    if salt == 1 and not skew_is_split(spark):
        log.warning(
            "adaptive skew joins are off: pass salt > 1 if one foreign key may hold many rows"
        )
