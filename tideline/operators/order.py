"""SRT2: a certificate that rows are in order, in place of trusting a sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS = "part int, n_rows bigint, inversions bigint, first string, last string"


def ranged(df: DataFrame, by: str, parts: int | None = None) -> DataFrame:
    """``df`` in ranges of a text column, each in order: together the global order."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, by).sortWithinPartitions(by)


def parts(df: DataFrame, by: str) -> DataFrame:
    """One row per partition of ``df``: its rows, how many follow a greater one, first and last.

    Nulls come first, as in Spark's own order. Partitions without rows give none.
    """
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = wrong = 0
        first = last = None
        for batch in batches:
            values = batch.column(0)
            if not len(values):
                continue
            if n == 0:
                first = values[0].as_py()
            chain = pa.concat_arrays([pa.array([last], values.type), values]) if n else values
            left, right = chain.slice(0, len(chain) - 1), chain.slice(1)
            falls = pc.or_kleene(pc.greater(left, right), pc.and_(pc.is_valid(left), pc.is_null(right)))
            wrong += pc.sum(falls).as_py() or 0
            n, last = n + len(values), values[-1].as_py()
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n]), pa.array([wrong]),
                 pa.array([first], pa.string()), pa.array([last], pa.string())],
                names=["part", "n_rows", "inversions", "first", "last"])

    return df.select(F.col(by).cast("string")).mapInArrow(look, PARTS)


def certificate(df: DataFrame, by: str) -> DataFrame:
    """One row: ``n_rows``, ``inversions`` within partitions, and ``out_of_order`` partitions, which begin before the last one ends.

    Reads ``df`` once, in the order its tasks have; what meets in one place is a row per partition.
    """
    found = parts(df, by)
    before = F.lag("last").over(Window.orderBy("part"))
    late = (before > F.col("first")) | (before.isNotNull() & F.col("first").isNull())
    return found.withColumn("_late", F.coalesce(late, F.lit(False))).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("inversions"), F.lit(0)).alias("inversions"),
        F.count_if("_late").alias("out_of_order"))
