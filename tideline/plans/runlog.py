"""AGG10: timers, the fatal error meter and the in-flight count of runs."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# Values of one block of a histogram.
BLOCK_MS = 4096
RUNS_SCHEMA = "phase string, started_ms bigint, duration_ms bigint, started boolean, ended boolean"


class Phases:
    """The phases one round went through, with their times. One that raised has no end."""

    def __init__(self) -> None:
        self.rows: list[list] = []

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        row = [name, time.time_ns() // 1_000_000, None, True, False]
        self.rows.append(row)
        began = time.monotonic()
        yield
        row[2:] = round((time.monotonic() - began) * 1000), True, True

    def write(self, spark: SparkSession, path: str) -> None:
        """A row per phase; written again as a round goes on, so a crash leaves what it was in."""
        spark.createDataFrame(self.rows, RUNS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def percentiles(counts: DataFrame, percents: dict[str, int]) -> DataFrame:
    """Exact discrete percentiles of ``duration_ms`` per phase: the value at rank ceil(n * percent / 100).

    ``counts``: phase, duration_ms, n, a row per value. Sums by block of ``BLOCK_MS`` values find the block
    a rank lies in, then only that block is ordered, so no phase is gathered in one place.
    """
    some = counts.where("duration_ms IS NOT NULL").withColumn("_block", F.expr(f"duration_ms div {BLOCK_MS}"))
    upto = Window.partitionBy("phase").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = F.array(*[
        F.struct(F.lit(name).alias("name"), F.expr(f"(_total * {percent} + 99) div 100").alias("rank"))
        for name, percent in percents.items()])
    blocks = (
        some.groupBy("phase", "_block").agg(F.sum("n").alias("_n"))
        .withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(Window.partitionBy("phase"))})
        .select(F.col("phase").alias("_phase"), F.col("_block").alias("_at"), "_upto",
                (F.col("_upto") - F.col("_n")).alias("_before"), F.explode(ranks).alias("_wanted"))
        .where("_wanted.rank > _before AND _wanted.rank <= _upto")
    )
    inside = Window.partitionBy("phase", "_wanted.name").orderBy("duration_ms").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # A run may have no phase: its null is a group of its own.
    met = some.join(blocks, F.col("phase").eqNullSafe(F.col("_phase")) & (F.col("_block") == F.col("_at"))).withColumn(
        "_reached", F.col("_before") + F.sum("n").over(inside) >= F.col("_wanted.rank"))
    return met.groupBy("phase").agg(*[
        F.min(F.when(F.col("_reached") & (F.col("_wanted.name") == name), F.col("duration_ms"))).alias(name)
        for name in percents])


def phase_timers(runs: DataFrame) -> DataFrame:
    """Per phase: count, extremes, total and exact percentiles of ``duration_ms``."""
    counts = runs.groupBy("phase", "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    timers = counts.groupBy("phase").agg(
        F.sum("n").alias("n_runs"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.sum(F.col("duration_ms") * F.col("n")).cast("bigint").alias("total_ms"),
    )
    marks = percentiles(counts, {"p50_ms": 50, "p95_ms": 95}).withColumnRenamed("phase", "_phase")
    return timers.join(marks, F.col("phase").eqNullSafe(F.col("_phase")), "left").drop("_phase")


def fatal_errors(reports: DataFrame, minutes: int = 1) -> DataFrame:
    """Fatal errors per minute; non-fatal kinds are not metered."""
    return (
        reports.where("is_fatal")
        .groupBy(F.window("ts", f"{minutes} minutes").start.alias("minute"))
        .agg(F.count(F.lit(1)).alias("n_fatal"))
    )


def in_flight(runs: DataFrame) -> DataFrame:
    """Runs started and not ended, from (phase, started, ended) flags."""
    return runs.groupBy("phase").agg(
        (F.count_if("started") - F.count_if("ended")).alias("in_flight")
    )


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Row count and bytes of a running job without a second pass."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation
