"""Times the headline queries and the three jobs; prints one JSON line.

BENCH_SF_DIR names the test tables and BENCH_CPUS the cores. The jobs start from CSV
files written beforehand and run once each, as a nightly batch would.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from datetime import date
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracles import adapter  # noqa: E402
from oracles.queries import KEY_TYPE, QUERIES  # noqa: E402
from stratacart.plans import jobs  # noqa: E402
from stratacart.schemas import GOLD  # noqa: E402
from stratacart.session import open_session  # noqa: E402
from stratacart.sources.landing import read_csv  # noqa: E402
from stratacart.sources.scratch import scratch_path  # noqa: E402

HEADLINE = [*GOLD, "fact_orders", "fact_order_items", "fact_reviews", "dm_sales_by_product_dirty"]
DAY = date(2024, 1, 31)


def seconds(action: Callable[[], object]) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = open_session(
        "bench",
        shuffle_partitions=int(cpus),
        conf={
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.sql.session.timeZone": "UTC",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    root = scratch_path(spark, "bench")
    sources = {}
    for name, make in adapter.BRONZE.items():
        make(spark, sf_dir).write.option("header", True).csv(f"{root}/landing/{name}")
        sources[name] = read_csv(spark, f"{root}/landing/{name}")

    def bronze() -> None:
        jobs.run_bronze(sources, f"{root}/bronze", DAY)

    def silver() -> None:
        jobs.run_silver(spark, f"{root}/bronze", f"{root}/silver", DAY, KEY_TYPE)

    def gold() -> None:
        jobs.run_gold(
            spark, jobs.parquet_sink(f"{root}/gold"), root=f"{root}/silver", key_type=KEY_TYPE
        )

    timings = {
        "job_bronze": seconds(bronze),
        "job_silver": seconds(silver),
        "job_gold": seconds(gold),
    }
    for name in HEADLINE:
        query = QUERIES[name]
        timings[name] = seconds(
            lambda q=query: q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        )
    print(
        json.dumps(
            {
                "metric": "total time of jobs and headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
