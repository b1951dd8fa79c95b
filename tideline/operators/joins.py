"""Joining a big table with a per-key table without trusting its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import scratch_dir

# Bytes of the written per-key table. In memory it is a few times that.
BROADCAST_BYTES = 64 * 1024 * 1024


def settled(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a reduced table into the shared folder and read it back.

    Cuts the lineage so that later steps neither repeat nor depend on what came
    before, also when executors are lost, and gives the planner a true size. Not a
    cache entry: cached plans are matched by path, which would hand an old listing
    of a spool directory to the next round.
    """
    path = path or scratch_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes_below(df: DataFrame, path: str) -> int:
    jvm = df.sparkSession._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return fs.getContentSummary(hadoop_path).getLength()


def measured(small: DataFrame) -> tuple[DataFrame, int]:
    """A per-key table written out, with the bytes it takes."""
    path = scratch_dir(small.sparkSession, "keys")
    return settled(small, path), _bytes_below(small, path)


def join_measured(big: DataFrame, small: tuple[DataFrame, int], on: list[str],
                  how: str = "left", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Equi-join where ``small`` has one row per key and ``big`` may be skewed.

    Only a table within the bound is broadcast, which keeps the big side where it
    is, hot keys included. Beyond the bound both sides are shuffled on the keys and
    adaptive execution splits the skewed partitions.
    """
    table, size = small
    return big.join(F.broadcast(table) if size <= broadcast_bytes else table, on, how)


def join_keyed(big: DataFrame, small: DataFrame, on: list[str], how: str = "left",
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """:func:`join_measured` on a table that is first written out."""
    return join_measured(big, measured(small), on, how, broadcast_bytes)
