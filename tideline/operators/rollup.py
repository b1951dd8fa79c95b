"""Telemetry rollup: sums per window and key, zero-filled and capped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.telemetry import DEFAULT_KEYS
from tideline.operators.joins import settled

WINDOW_SECONDS = 30
MAX_RECORDS = 1000
SALTS = 32


def window_start_ms(ts: Column, seconds: int = WINDOW_SECONDS) -> Column:
    """Start of the tumbling window in epoch milliseconds."""
    width = F.lit(seconds * 1000)
    ms = F.unix_millis(ts)
    return ms - F.pmod(ms, width)


def sum_by_key(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG5: sum of amounts by key."""
    return records.groupBy(*by, "key").agg(F.sum("amount").cast("bigint").alias("total"))


def newest_records(records: DataFrame, by: Sequence[str], cap: int = MAX_RECORDS,
                   newest_first: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """W3: the newest ``cap`` records of every group, exactly.

    Two ranked steps: within a salt of the group, then over the at most
    ``SALTS * cap`` survivors. The first step is also limited on the map side,
    so one crowded window never meets in one task.
    """
    order = [F.col(c).desc() for c in newest_first]
    salt = F.pmod(F.xxhash64(*newest_first), F.lit(SALTS))
    salted = Window.partitionBy(*by, "_salt").orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order)
    return (
        records.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(salted))
        .where(F.col("_rank") <= cap)
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= cap)
        .drop("_rank", "_salt")
    )


def zero_rows(groups: DataFrame, by: Sequence[str], cap: int | None = None,
              default_keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """AGG6: a zero for every default key of every group.

    ``groups`` has one row per group with ``n_records``. The zeros are the oldest
    entries of a group, in the order of ``default_keys``, so they are the first to
    fall out when records and zeros together exceed the cap.
    """
    zeros = F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(len(default_keys) - i).alias("age"))
          for i, k in enumerate(default_keys)]
    )
    rows = groups.select(*by, "n_records", F.explode(zeros).alias("_zero"))
    if cap is not None:
        rows = rows.where(F.col("n_records") + F.col("_zero.age") <= cap)
    return rows.select(*by, F.col("_zero.key").alias("key"), F.lit(0).alias("amount"))


def rollup(records: DataFrame, by: Sequence[str] = (), cap: int | None = None,
           seconds: int = WINDOW_SECONDS,
           default_keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """JOB7: (window, *by, key, total) over every window that has a record.

    One partial aggregate and a union of zeros over all records. A ``cap`` keeps the
    newest of each group only, as one monitor's buffer does: then ``by`` must name the
    monitor, and :func:`dropped_records` says what was left out.
    """
    group = ["window_ms", *by]
    windowed = records.withColumn("window_ms", window_start_ms(F.col("ts"), seconds))
    kept = windowed if cap is None else newest_records(windowed, group, cap)
    sums = kept.groupBy(*group, "key").agg(
        F.sum("amount").cast("bigint").alias("total"), F.count(F.lit(1)).alias("_n")
    )
    groups = sums.groupBy(*group).agg(F.sum("_n").alias("n_records"))
    zeros = zero_rows(groups, group, cap, default_keys).select(
        *group, "key", F.col("amount").cast("bigint").alias("total")
    )
    return (
        sums.drop("_n").unionByName(zeros)
        .groupBy(*group, "key")
        .agg(F.sum("total").cast("bigint").alias("total"))
    )


def dropped_records(records: DataFrame, by: Sequence[str], cap: int = MAX_RECORDS,
                    seconds: int = WINDOW_SECONDS) -> DataFrame:
    """How many records of each window and group a cap leaves out; groups within it have no row."""
    windowed = records.withColumn("window_ms", window_start_ms(F.col("ts"), seconds))
    counts = windowed.groupBy("window_ms", *by).agg(F.count(F.lit(1)).alias("n_records"))
    return counts.where(F.col("n_records") > cap).withColumn(
        "n_dropped", F.col("n_records") - cap)


def with_empty_windows(rolled: DataFrame, lo_ms: int, hi_ms: int, seconds: int = WINDOW_SECONDS,
                       default_keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Add zeros for the windows in [lo_ms, hi_ms) that have no record at all.

    ``rolled`` should be a written table: it is read twice. The window list is a
    range, bounded by the time span and not by the records.
    """
    windows = rolled.sparkSession.range(lo_ms, hi_ms, seconds * 1000).withColumnRenamed(
        "id", "window_ms"
    )
    empty = windows.join(rolled.select("window_ms").distinct(), "window_ms", "left_anti")
    zeros = empty.select("window_ms", F.explode(F.array(*[F.lit(k) for k in default_keys]))
                         .alias("key"), F.lit(0).cast("bigint").alias("total"))
    return rolled.unionByName(zeros)


def fill_empty_windows(rolled: DataFrame, seconds: int = WINDOW_SECONDS,
                       default_keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """SET3: zeros for windows without any record between the first and the last."""
    rolled = settled(rolled)
    lo, hi = rolled.agg(F.min("window_ms"), F.max("window_ms")).first()
    if lo is None:
        return rolled
    return with_empty_windows(rolled, lo, hi + seconds * 1000, seconds, default_keys)
