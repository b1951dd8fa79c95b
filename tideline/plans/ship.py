"""JOB1 ship plan and JOB2 outstanding files, for all services at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import labels, names, predicates
from tideline.operators import inventory, watermark
from tideline.operators.inventory import DAY_MS, DIR_KEYS, KEYS, MAX_LOOK_BACK_DAYS, as_of_ms, clock_ms
from tideline.operators.joins import join_keyed

SHIP_INTERVAL_SECONDS = 3600
MAX_READY_BYTES = 1024**3


def ship_plan(files: DataFrame, archive: DataFrame, as_of: str,
              interval_seconds: int | Column = SHIP_INTERVAL_SECONDS,
              max_ready_bytes: int | Column = MAX_READY_BYTES,
              max_look_back_days: int = MAX_LOOK_BACK_DAYS,
              keys: Sequence[str] = KEYS, dir_keys: Sequence[str] = DIR_KEYS,
              leap_table: labels.LeapTable = labels.LEAP_TABLE) -> DataFrame:
    """JOB1: one row per service directory with the decision and what it rests on.

    ``files`` is a usable inventory, ``archive`` the parsed catalogue. "Elapsed"
    counts from the last shipped label and ``ready_bytes`` covers all retained
    files, shipped ones included.
    """
    state = inventory.directory_state(files, as_of, max_look_back_days, dir_keys, leap_table)
    return plan_of_state(state, archive, as_of, interval_seconds, max_ready_bytes,
                         max_look_back_days, keys, dir_keys, leap_table)


def plan_of_state(state: DataFrame, archive: DataFrame, as_of: str,
                  interval_seconds: int | Column = SHIP_INTERVAL_SECONDS,
                  max_ready_bytes: int | Column = MAX_READY_BYTES,
                  max_look_back_days: int = MAX_LOOK_BACK_DAYS,
                  keys: Sequence[str] = KEYS, dir_keys: Sequence[str] = DIR_KEYS,
                  leap_table: labels.LeapTable = labels.LEAP_TABLE) -> DataFrame:
    """JOB1 on one row per directory, as ``inventory.directory_state`` or a kept index has them."""
    marked = watermark.service_watermarks(state, archive, as_of, keys, max_look_back_days)
    marked = marked.withColumn("_last_ms", labels.decode_ms(F.col("last_taistamp"), leap_table))
    last_ms, now = F.col("_last_ms"), as_of_ms(as_of)
    decision = predicates.ship_decision(
        last_ms, now, interval_seconds, F.col("ready_bytes"), max_ready_bytes
    )
    today = F.lit(as_of).cast("timestamp")
    return marked.select(
        *dir_keys,
        decision.alias("decision"),
        (decision != "throttled").alias("ships"),
        names.day_path(names.day_bucket(today)).alias("target_dir"),
        F.lit(names.TEMP_PATH).alias("temp_dir"),
        "last_taistamp", "ready_bytes", "n_files", "lookback_ms",
        F.when(last_ms > now, "future_label")
        .when(decision == "throttled", "sync_throttled")
        .alias("error_kind"),
    )


def age_limit_ms(as_of: str, max_look_back_days: int = MAX_LOOK_BACK_DAYS) -> int:
    """Midnight of the day ``max_look_back_days`` + 1 days before the clock."""
    return clock_ms(as_of) // DAY_MS * DAY_MS - (max_look_back_days + 1) * DAY_MS


def age_limit_label(as_of: str, max_look_back_days: int = MAX_LOOK_BACK_DAYS,
                    leap_table: labels.LeapTable = labels.LEAP_TABLE) -> str:
    """The age limit as a constant label."""
    return labels.first_label_at(age_limit_ms(as_of, max_look_back_days), leap_table)


def with_plan(files: DataFrame, plan: DataFrame,
              dir_keys: Sequence[str] = DIR_KEYS) -> DataFrame:
    """JN2, equi part: each file with its directory's decision and watermark."""
    return join_keyed(files, plan.select(*dir_keys, "ships", "last_taistamp"),
                      list(dir_keys), "inner")


def outstanding(files: DataFrame, plan: DataFrame, as_of: str,
                max_look_back_days: int = MAX_LOOK_BACK_DAYS,
                dir_keys: Sequence[str] = DIR_KEYS,
                shipped: DataFrame | None = None) -> DataFrame:
    """JOB2: files of shipping directories after the watermark and young enough.

    ``shipped`` is the ledger reduced to (keys, ledger_label): with it, a service
    that was silent longer than the look-back does not ship its files twice.
    """
    if shipped is not None:
        on = [c for c in shipped.columns if c != "ledger_label"]
        plan = plan.join(shipped, on, "left").withColumn(
            "last_taistamp", F.greatest("last_taistamp", "ledger_label")
        )
    fresh = F.coalesce(F.col("label") > F.col("last_taistamp"), F.lit(True))
    young = files.where(F.col("label") >= age_limit_label(as_of, max_look_back_days))
    return (
        with_plan(young, plan.where("ships"), dir_keys)
        .where(fresh)
        .drop("ships", "last_taistamp")
    )


def late_files(files: DataFrame, plan: DataFrame, as_of: str,
               max_look_back_days: int = MAX_LOOK_BACK_DAYS,
               dir_keys: Sequence[str] = DIR_KEYS) -> DataFrame:
    """STR4: files that can never ship any more, with the reason."""
    reason = F.when(F.col("label") <= F.col("last_taistamp"), "behind_watermark").when(
        F.col("label") < age_limit_label(as_of, max_look_back_days), "too_old"
    )
    return (
        with_plan(files, plan, dir_keys)
        .withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .drop("ships", "last_taistamp")
    )


def nothing_to_sync(plan: DataFrame, outstanding_files: DataFrame,
                    dir_keys: Sequence[str] = DIR_KEYS) -> DataFrame:
    """Directories that were due but had no file left, as non-fatal errors."""
    return (
        plan.where("ships")
        .join(outstanding_files.select(*dir_keys).distinct(), list(dir_keys), "left_anti")
        .select(*dir_keys, F.lit("nothing_to_sync").alias("error_kind"),
                F.lit(False).alias("is_fatal"))
    )
