from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

SF_DIR = "/root/testdata/sf0.001"
DAY = date(2024, 1, 31)
NEXT_DAY = date(2024, 2, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf_dir() -> str:
    return SF_DIR


@pytest.fixture
def with_conf(spark):
    """Sessions that share the context but have settings of their own."""

    def make(**settings) -> SparkSession:
        session = spark.newSession()
        for name, value in settings.items():
            session.conf.set(name.replace("__", "."), value)
        return session

    return make


def plan_of(df) -> str:
    """The executed plan, as adaptive execution left it after running the query."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def executed_plan():
    return plan_of
