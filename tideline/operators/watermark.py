"""What the archive already holds: look-back filter and last shipped labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.inventory import DAY_MS, KEYS, MAX_LOOK_BACK_DAYS, as_of_ms
from tideline.operators.joins import join_keyed


def in_lookback(dir_date: Column, as_of: str, lower_ms: Column) -> Column:
    """FLT6: today's directory, and every earlier one down to the bound's own day."""
    today = F.to_date(F.lit(as_of).cast("timestamp"))
    lower = F.to_date(F.timestamp_millis(lower_ms))
    return (dir_date == today) | ((dir_date >= lower) & (dir_date < today))


def recent(archive: DataFrame, as_of: str, days: int = MAX_LOOK_BACK_DAYS) -> DataFrame:
    """The widest look-back any service can have, as a constant range on the day.

    On a catalogue partitioned by ``dir_date`` this prunes partitions before the
    per-service bound is applied.
    """
    return archive.where(
        in_lookback(F.col("dir_date"), as_of, as_of_ms(as_of) - F.lit(days * DAY_MS))
    )


def watermarks(archive: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """AGG2: greatest label inside the newest directory that holds the key.

    ``max`` of the struct (day, label) is that label: one partial aggregate, no
    sort and no window, and a hot key costs one row per map task.
    """
    return (
        archive.groupBy(*keys)
        .agg(F.max(F.struct("dir_date", "taistamp")).alias("_newest"))
        .select(*keys, F.col("_newest.dir_date").alias("newest_dir"),
                F.col("_newest.taistamp").alias("last_taistamp"))
    )


def service_watermarks(services: DataFrame, archive: DataFrame, as_of: str,
                       keys: Sequence[str] = KEYS,
                       days: int = MAX_LOOK_BACK_DAYS) -> DataFrame:
    """JN1: each service directory with its watermark, NULL when never shipped.

    ``services`` has one row per directory with its own ``lookback_ms``. The
    archive is first reduced to one row per key and day; only that is joined, so
    the join sees neither long listings nor hot keys.
    """
    per_day = (
        recent(archive, as_of, days)
        .groupBy(*keys, "dir_date")
        .agg(F.max("taistamp").alias("taistamp"))
    )
    seen = services.join(per_day, list(keys), "left").withColumn(
        "_day",
        F.when(in_lookback(F.col("dir_date"), as_of, F.col("lookback_ms")),
               F.struct("dir_date", "taistamp")),
    )
    others = [c for c in services.columns]
    return (
        seen.groupBy(*others)
        .agg(F.max("_day").alias("_newest"))
        .select(*others, F.col("_newest.taistamp").alias("last_taistamp"))
    )


def newest_day_files(archive: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """W2: the archive files in the newest day of each key.

    Rank-one over days is a per-key maximum joined back, not a window that would
    sort a hot key in one task.
    """
    newest = archive.groupBy(*keys).agg(F.max("dir_date").alias("dir_date"))
    return join_keyed(archive, newest, [*keys, "dir_date"], "left_semi")


def first_last(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """W4 / SRT3: first and last name and label of each group."""
    return files.groupBy(*keys).agg(
        F.min("file_name").alias("first_name"),
        F.max("file_name").alias("last_name"),
        F.max_by("size_bytes", "file_name").alias("last_size_bytes"),
    )
