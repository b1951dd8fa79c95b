"""Rotated file inventory: validation, enrichment and per-directory aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import labels, names, predicates

DIR_KEYS = ["service", "category", "host"]
KEYS = ["service", "host"]
MAX_LOOK_BACK_DAYS = 3
DAY_MS = 86_400_000


def clock_ms(as_of: str) -> int:
    """The fixed clock of a run, UTC. Operators never read the wall clock."""
    at = datetime.fromisoformat(as_of).replace(tzinfo=timezone.utc)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)


def as_of_ms(as_of: str) -> Column:
    return F.lit(clock_ms(as_of)).cast("bigint")


def enrich(files: DataFrame) -> DataFrame:
    """PRJ1: add label and ``name_ok`` to an inventory."""
    ok = F.coalesce(labels.is_rotated_name(F.col("file_name")), F.lit(False))
    return files.withColumns(
        {"name_ok": ok, "label": F.when(ok, labels.label_of(F.col("file_name")))}
    )


def with_time(files: DataFrame, leap_table: labels.LeapTable = labels.LEAP_TABLE) -> DataFrame:
    """PRJ2: add the event time of each label in epoch milliseconds."""
    return files.withColumn("label_ms", labels.decode_ms(F.col("label"), leap_table))


def usable(files: DataFrame, exclude: Sequence[str] = predicates.HIDDEN_FILES,
           strict: bool = False) -> DataFrame:
    """FLT1, then enrichment, then only well named files.

    Badly named files are left to :func:`quarantine`; with ``strict`` the first
    one fails the job instead.
    """
    enriched = enrich(files.where(~predicates.excluded(F.col("file_name"), exclude)))
    if strict:
        bad = F.raise_error(F.concat(F.lit("bad rotated file name: "), F.col("file_name")))
        enriched = enriched.withColumn("name_ok", F.when(F.col("name_ok"), True).otherwise(bad))
    return enriched.where("name_ok").drop("name_ok")


def quarantine(files: DataFrame, exclude: Sequence[str] = predicates.HIDDEN_FILES) -> DataFrame:
    """Files whose names carry no label, with an error kind."""
    return (
        enrich(files.where(~predicates.excluded(F.col("file_name"), exclude)))
        .where("NOT name_ok")
        .select(*DIR_KEYS, "file_name",
                F.lit("invalid_name").alias("error_kind"),
                F.concat(F.lit("no label in "), F.col("file_name")).alias("error_detail"),
                F.lit(True).alias("is_fatal"))
    )


def service_dirs(listing: DataFrame) -> DataFrame:
    """SRC2 + PRJ4: the distinct service directories of a listing."""
    return names.with_service_identity(listing.select("dir_name").distinct())


def ready_bytes(files: DataFrame, keys: Sequence[str] = DIR_KEYS) -> DataFrame:
    """AGG1: bytes per service directory, shipped files included."""
    return files.groupBy(*keys).agg(F.sum("size_bytes").alias("ready_bytes"))


def lookback_floor_ms(oldest_ms: Column, as_of: str, days: int = MAX_LOOK_BACK_DAYS) -> Column:
    """AGG3 rule: the later of the oldest file time and ``days`` before the clock."""
    limit = as_of_ms(as_of) - F.lit(days * DAY_MS)
    return F.greatest(F.coalesce(oldest_ms, limit), limit)


def directory_state(files: DataFrame, as_of: str, days: int = MAX_LOOK_BACK_DAYS,
                    keys: Sequence[str] = DIR_KEYS,
                    leap_table: labels.LeapTable = labels.LEAP_TABLE) -> DataFrame:
    """AGG1 + AGG3 + W4 in one pass: bytes, first and last label, look-back bound.

    Plain min, max and sum, so the shuffle carries one row per directory and map
    task however large a directory is.
    """
    state = files.groupBy(*keys).agg(
        F.sum("size_bytes").alias("ready_bytes"),
        F.count(F.lit(1)).alias("n_files"),
        F.min("label").alias("first_label"),
        F.max("label").alias("last_label"),
    )
    return with_lookback(state, as_of, days, leap_table)


def with_lookback(state: DataFrame, as_of: str, days: int = MAX_LOOK_BACK_DAYS,
                  leap_table: labels.LeapTable = labels.LEAP_TABLE) -> DataFrame:
    """AGG3 on one row per directory: the look-back bound of its first label."""
    first_ms = labels.decode_ms(F.col("first_label"), leap_table)
    return state.withColumn("lookback_ms", lookback_floor_ms(first_ms, as_of, days))
