"""Time every registered query and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local threads. Each query
runs whole into a sink that drops the rows; ``queries`` holds the time of a second run,
``cold`` that of the first.
"""

from __future__ import annotations

import json
import os
import pathlib
import time

from footfall.plans.queries import QUERIES
from footfall.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def timed(spark, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": CPUS if CPUS.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{FOLDER}/events.parquet").count()
    cold = {name: timed(spark, name) for name in QUERIES}
    warm = {name: timed(spark, name) for name in QUERIES}
    print(
        json.dumps(
            {
                "metric": "total seconds of all registered queries, warm",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "sf": pathlib.Path(FOLDER).name.removeprefix("sf"),
                "cold": cold,
                "cold_total": round(sum(cold.values()), 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
