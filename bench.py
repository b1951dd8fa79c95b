"""Time the headline jobs over $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
JOBS = [
    "job1_ship_plan", "job2_outstanding", "job3_merged_lines", "job4_retention",
    "job5_agent_candidates", "job6_ship_stats", "job7_telemetry", "job8_failover",
    "job9_route", "job9_subscriptions", "job10_catalogue", "prj2_label_time",
    "prj3_time_label", "prj9_utf8_repair", "w3_newest_records",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("tideline-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    spark = session()
    seconds(spark, "job10_quarantine")  # start workers and load classes
    # The better of two runs: the first one also compiles the generated code.
    first = {name: seconds(spark, name) for name in JOBS}
    times = {name: round(min(first[name], seconds(spark, name)), 3) for name in JOBS}
    lines = QUERIES["job3_merged_lines"](spark, SF_DIR).count()
    print(json.dumps({
        "metric": "headline_jobs_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "first_run_total": round(sum(first.values()), 3),
        "job3_lines_per_sec": round(lines / times["job3_merged_lines"]),
        "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
