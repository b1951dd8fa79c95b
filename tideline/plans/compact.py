"""JOB3: merge the lines of all outstanding files into archive units.

A unit is one directory's batch, named by its last label. The unit of parallel
work is a shard of it: a label range small enough for one task. Shards come from
the inventory (names and sizes), so the lines, the only big table, are filtered by
a small per-directory table and shuffled exactly once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import labels, names, text
from tideline.operators.inventory import DIR_KEYS, as_of_ms
from tideline.operators.joins import join_measured, measured

SHARD_BYTES = 512 * 1024 * 1024
# Label digits a shard may be cut by: whole unit, 4096 s, 1 s, single file.
SHARD_WIDTHS = (0, 13, 16, 24)
# Columns that become folders of the archive.
FOLDERS = ("service", "host")


def batches(outstanding_files: DataFrame, shard_bytes: int = SHARD_BYTES,
            dir_keys: Sequence[str] = DIR_KEYS,
            leap_table: labels.LeapTable = labels.LEAP_TABLE) -> DataFrame:
    """One row per unit: label range, archive name, bytes, and the shard width.

    The width is the coarsest one whose biggest shard still fits ``shard_bytes``,
    found by sums per prefix that are partial aggregates down to one row per unit.
    """
    keys = list(dir_keys)
    fine = outstanding_files.groupBy(*keys, F.substring("label", 1, 16).alias("_p16")).agg(
        F.sum("size_bytes").alias("_b16"),
        F.min("label").alias("_lo"), F.max("label").alias("_hi"),
        F.count(F.lit(1)).alias("_n"),
    )
    coarse = fine.groupBy(*keys, F.substring("_p16", 1, 13).alias("_p13")).agg(
        F.sum("_b16").alias("_b13"), F.max("_b16").alias("_b16"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_n").alias("_n"),
    )
    whole = coarse.groupBy(*keys).agg(
        F.min("_lo").alias("first_label"), F.max("_hi").alias("last_label"),
        F.sum("_n").alias("n_files"), F.sum("_b13").alias("bytes"),
        F.max("_b13").alias("_b13"), F.max("_b16").alias("_b16"),
    )
    width = (
        F.when(F.col("bytes") <= shard_bytes, SHARD_WIDTHS[0])
        .when(F.col("_b13") <= shard_bytes, SHARD_WIDTHS[1])
        .when(F.col("_b16") <= shard_bytes, SHARD_WIDTHS[2])
        .otherwise(SHARD_WIDTHS[3])
    )
    return whole.select(
        *keys, "first_label", "last_label", "n_files", "bytes",
        width.alias("shard_width"),
        names.archive_name(F.col("last_label"), F.col("service"), F.col("host"), leap_table)
        .alias("archive_name"),
    )


def shard_tasks(units: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """Shuffle partitions for the merge: two per shard's worth of bytes."""
    total = units.agg(F.sum("bytes")).first()[0] or 0
    floor = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, math.ceil(2 * total / shard_bytes))


def merged_lines(lines: DataFrame, units: DataFrame, as_of: str,
                 shard_bytes: int = SHARD_BYTES,
                 dir_keys: Sequence[str] = DIR_KEYS) -> DataFrame:
    """JOB3 / SRT1: repaired lines of every unit, ordered within its shards.

    ``lines``: directory keys, file_name, block, pos, line. Only files inside a
    unit's label range take part: a file that appeared after the inventory was
    taken waits for the next round. A file larger than a shard is cut by bytes.
    """
    keys = list(dir_keys)
    table = measured(units)
    tasks = shard_tasks(table[0], shard_bytes)
    label = labels.label_of(F.col("file_name"))
    inside = (
        join_measured(
            lines.where(labels.is_rotated_name(F.col("file_name"))).withColumn("label", label),
            table, keys, "inner",
        )
        .where(F.col("label").between(F.col("first_label"), F.col("last_label")))
    )
    part = F.floor(F.col("block") / F.lit(shard_bytes)).cast("bigint")
    shard = F.concat_ws(
        ".",
        F.substr(F.col("label"), F.lit(1), F.col("shard_width")),
        F.when(F.col("shard_width") == SHARD_WIDTHS[-1], F.lpad(part.cast("string"), 6, "0")),
    )
    return (
        inside.select(
            *keys, "archive_name", shard.alias("shard"), "label", "block", "pos",
            as_of_ms(as_of).alias("ship_ms"), text.repair_utf8(F.col("line")).alias("line"),
        )
        .repartition(tasks, *keys, "shard")
        .sortWithinPartitions(
            *FOLDERS, *[k for k in keys if k not in FOLDERS], "shard", "label", "block", "pos"
        )
    )
