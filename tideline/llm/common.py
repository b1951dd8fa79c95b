"""Small helpers the operators share: settled tables, running totals, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.joins import settled

__all__ = ["components", "fanout", "running_total", "settled", "small_batches", "table", "words"]

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fanout(spark: SparkSession) -> int:
    """Partitions for an explicit shuffle: the cluster's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Within, rows travel to Python workers in Arrow batches of about ``size`` bytes, for rows of megabytes.

    Spark's own bound is 64 MB, of which executor and worker hold several copies for each task. Holds for what is run
    within; only how many rows travel together changes.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def words(text):
    """Number of white-space separated words of a column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, order: list[str], value: str, out: str = "before") -> DataFrame:
    """Add ``out``: the sum of ``value`` (long, not null) over all rows that come earlier in ``order``.

    One range shuffle; each task sums its own sorted range, and the ranges' totals (one row
    each) are carried over. A frequent value of a leading column is no hot spot as long as
    later columns of ``order`` tell its rows apart. Rows equal in all of ``order`` come in
    any order among themselves. An empty table gives an empty table.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType()),
                           T.StructField("_range", T.IntegerType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry = TaskContext.get().partitionId(), 0
        for batch in batches:
            one = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
            ends = np.cumsum(one.astype(np.int64)) + carry
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ends - one), pa.array(np.full(len(one), part, np.int32))],
                names=[*batch.schema.names, out, "_range"])
            carry = int(ends[-1]) if len(ends) else carry

    ordered = df.repartitionByRange(fanout(df.sparkSession), *order).sortWithinPartitions(*order)
    local = settled(ordered.mapInArrow(add, schema))
    totals = local.groupBy("_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    # One row per range: as many as there are shuffle partitions.
    return (local.join(F.broadcast(bases), "_range")
            .withColumn(out, F.col(out) + F.col("_base")).drop("_range", "_base"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: ``id`` and ``component``, the least id that links lead to.

    ``nodes`` has ``id``; ``edges`` has ``a`` and ``b`` (long, not null). Alternates large-star
    and small-star steps, so that a chain of any length needs few rounds and a hub never has
    all its neighbours collected in one place: only minima are taken over neighbours.
    """
    links = edges.where("a <> b").select(
        F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    links = settled(links)
    mark = [F.count("*"), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 31)))]
    seen = links.agg(*mark).first()
    while seen[0]:
        # Large star: each node's larger neighbours move to its least neighbour.
        both = links.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionByName(
            links.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("r")).select("n", F.least("n", "r").alias("r"))
        large = (both.where("m > n").join(least, "n")
                 .select(F.col("r").alias("lo"), F.col("m").alias("hi")).where("lo < hi").distinct())
        # Small star: each node and its smaller neighbours move to the least of them.
        large = settled(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("r"))
        small = (large.join(least, "hi")
                 .select(F.explode(F.array(F.struct("r", F.col("lo").alias("x")),
                                           F.struct("r", F.col("hi").alias("x")))).alias("e"))
                 .select(F.col("e.r").alias("lo"), F.col("e.x").alias("hi")).where("lo < hi").distinct())
        small = settled(small)
        links, now = small, small.agg(*mark).first()
        if now == seen:
            break
        seen = now
    found = links.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return nodes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
