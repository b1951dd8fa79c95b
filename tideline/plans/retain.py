"""JOB4: what may be removed from the service directories after a round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import labels
from tideline.operators import retention
from tideline.operators.inventory import DAY_MS, DIR_KEYS, MAX_LOOK_BACK_DAYS, clock_ms
from tideline.operators.joins import settled


def limits_of(totals: DataFrame, units: DataFrame, as_of: str,
              max_look_back_days: int = MAX_LOOK_BACK_DAYS,
              dir_keys: Sequence[str] = DIR_KEYS,
              leap_table: labels.LeapTable = labels.LEAP_TABLE) -> DataFrame:
    """Per directory the label from which files must stay.

    ``totals`` has one row per directory with ``total_bytes``; its other columns are kept.
    After a shipment: the time of the last shipped file. After anything else,
    throttling and nothing-to-sync included: a day more than the look-back ago.
    """
    keys = list(dir_keys)
    shipped = units.select(*keys, labels.floor_to_ms(F.col("last_label")).alias("_shipped"))
    days_ago = clock_ms(as_of) - (max_look_back_days + 1) * DAY_MS
    fallback = F.lit(labels.first_label_at(days_ago, leap_table))
    return (
        totals.join(shipped, keys, "left")
        .select(*totals.columns, F.coalesce("_shipped", fallback).alias("limit_label"))
    )


def retention_manifest(files: DataFrame, units: DataFrame, as_of: str,
                       min_bytes: int | Column = retention.MIN_BYTES,
                       max_look_back_days: int = MAX_LOOK_BACK_DAYS,
                       dir_keys: Sequence[str] = DIR_KEYS) -> DataFrame:
    """JOB4: every file of the inventory with ``to_delete``."""
    sums = settled(retention.per_second(files, dir_keys))
    totals = sums.groupBy(*dir_keys).agg(F.sum("bytes").alias("total_bytes"))
    limits = limits_of(totals, units, as_of, max_look_back_days, dir_keys)
    return retention.manifest(files, limits, dir_keys, min_bytes, sums)
