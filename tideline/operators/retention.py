"""W1 / AGG9: which files may go, keeping a floor of bytes per directory.

Oldest first over all but the newest file, a file goes while its time is before
the limit and the bytes left before that delete exceed the floor. Deletes form a
prefix, so "bytes left" before a file is the sum of its size and of all later
ones: a suffix sum that never rises along a directory. One label per directory,
the last one whose suffix sum still exceeds the floor, therefore decides.

That label is found by sums over ever shorter parts of the labels: one pass over the files
sums them by directory and second, which also gives the sums by 4096 seconds. The 4096 seconds in
which the sum crosses the floor are found first, then the second within them, then the file
within that second, for which only the files of one second per directory are looked at again.
Windows run over parts of time, so a directory with a third of all files is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.inventory import DIR_KEYS
from tideline.operators.joins import join_keyed, join_measured, measured, settled

MIN_BYTES = 1024 * 1024
# Hex digits of a label that tell 4096 seconds and single seconds apart.
COARSE, FINE = 13, 16


def per_second(files: DataFrame, keys: Sequence[str] = DIR_KEYS) -> DataFrame:
    """Bytes and newest label of each second of each directory, as a partial aggregate."""
    return files.groupBy(*keys, F.substring("label", 1, FINE).alias("second")).agg(
        F.sum("size_bytes").alias("bytes"), F.max("label").alias("newest_label"))


def _crossing(sums: DataFrame, state: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """Per key the greatest ``part`` whose suffix sum of ``bytes`` is still above the floor, and what lies after it."""
    newer = (
        Window.partitionBy(*keys).orderBy(F.col(part).desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    left = sums.join(state, keys).withColumn("_left", F.col("after") + F.sum("bytes").over(newer))
    return (
        left.where(F.col("_left") > F.col("min_bytes"))
        .groupBy(*keys, "min_bytes")
        .agg(F.max(F.struct(part, (F.col("_left") - F.col("bytes")).alias("after"))).alias("_at"))
        .select(*keys, "min_bytes", f"_at.{part}", "_at.after")
    )


def suffix_cut(files: DataFrame, sums: DataFrame, floors: DataFrame,
               keys: Sequence[str] = DIR_KEYS) -> DataFrame:
    """Per key ``cut_label``, the greatest label whose suffix sum exceeds ``min_bytes``.

    ``sums`` is ``per_second(files)``, ``floors`` has one row per key with ``min_bytes``. Keys whose
    total does not exceed the floor are absent.
    """
    keys = list(keys)
    hours = sums.withColumn("part", F.substring("second", 1, COARSE))
    start = floors.select(*keys, "min_bytes", F.lit(0).cast("bigint").alias("after"))
    coarse = _crossing(hours.groupBy(*keys, "part").agg(F.sum("bytes").alias("bytes")), start, "part", keys)
    inside = hours.join(coarse.select(*keys, "part"), [*keys, "part"], "left_semi")
    table, size = measured(_crossing(inside, coarse.drop("part"), "second", keys))
    second = files.select(*keys, "label", F.col("size_bytes").alias("bytes"), F.substring("label", 1, FINE).alias("second"))
    left = join_measured(second, (table.select(*keys, "second"), size), [*keys, "second"], "left_semi")
    cut = _crossing(left.groupBy(*keys, "label").agg(F.sum("bytes").alias("bytes")), table.drop("second"), "label", keys)
    return cut.select(*keys, F.col("label").alias("cut_label"))


def manifest(files: DataFrame, limits: DataFrame, keys: Sequence[str] = DIR_KEYS,
             min_bytes: int | Column = MIN_BYTES, sums: DataFrame | None = None) -> DataFrame:
    """W1: every file with ``to_delete``; ``sums`` may give the written ``per_second(files)``.

    ``limits`` has one row per directory with ``limit_label``, the first label too
    young to go (and, when ``min_bytes`` is a Column, whatever that column reads).
    """
    keys = list(keys)
    floor = min_bytes if isinstance(min_bytes, Column) else F.lit(min_bytes)
    floors = limits.select(*keys, "limit_label", floor.cast("bigint").alias("min_bytes"))
    sums = settled(per_second(files, keys)) if sums is None else sums
    newest = sums.groupBy(*keys).agg(F.max("newest_label").alias("newest_label"))
    cuts = suffix_cut(files, sums, floors, keys)
    per_key = floors.join(newest, keys, "left").join(cuts, keys, "left")
    deletable = (
        (F.col("label") <= F.col("cut_label"))
        & (F.col("label") < F.col("newest_label"))
        & (F.col("label") < F.col("limit_label"))
    )
    return join_keyed(files, per_key, keys, "left").select(
        *files.columns, F.coalesce(deletable, F.lit(False)).alias("to_delete")
    )


def summary(flagged: DataFrame, keys: Sequence[str] = DIR_KEYS) -> DataFrame:
    """AGG9: files deleted and whole KB left per directory."""
    kept = F.when(F.col("to_delete"), 0).otherwise(F.col("size_bytes"))
    return flagged.groupBy(*keys).agg(
        F.count_if("to_delete").alias("n_deleted"),
        F.floor(F.sum(kept) / F.lit(1024)).cast("bigint").alias("kb_left"),
    )
