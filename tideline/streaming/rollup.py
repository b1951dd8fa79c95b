"""STR2: the telemetry rollup as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.functions import telemetry
from tideline.functions.telemetry import DEFAULT_KEYS
from tideline.operators import rollup
from tideline.operators.inventory import clock_ms
from tideline.operators.joins import settled
from tideline.operators.rollup import WINDOW_SECONDS
from tideline.session import read_folders, scratch_scope
from tideline.streaming.shipping import batch_clock, utc_now

HOUR_MS = 3_600_000
# A stamp may be this much later than the batch that brings it.
AHEAD_SECONDS = 300
RECORD_SCHEMA = (
    "ts timestamp, seq bigint, service string, category string, key string, amount int, "
    "hour bigint, batch_id bigint"
)


def windowed_sums(reports: DataFrame, delay: str = "30 seconds",
                  seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Sum per event-time window and key, emitted when the watermark closes it.

    The plain form, neither capped nor zero-filled: all state is one number per
    window and key.
    """
    return (
        telemetry.good_reports(telemetry.parse(reports))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{seconds} seconds"), "key")
        .agg(F.sum("amount").cast("bigint").alias("total"))
        .select(F.unix_millis("window.start").alias("window_ms"), "key", "total")
    )


def _closed_before(spark: SparkSession, state_root: str, batch_id: int) -> int | None:
    """Bound up to which batch ``batch_id - 1`` had closed windows."""
    if batch_id == 0:
        return None
    rows = spark.read.parquet(f"{state_root}/progress/batch_id={batch_id - 1}").collect()
    return rows[0]["closed_ms"]


def _records(spark: SparkSession, state_root: str, lo: int | None = None,
             hi: int | None = None) -> DataFrame:
    """Staged records, from the hour folders that overlap [lo, hi) only."""
    def wanted(hour: str) -> bool:
        start = int(hour) * HOUR_MS
        return (hi is None or start < hi) and (lo is None or start + HOUR_MS > lo)

    return read_folders(spark, f"{state_root}/records", "hour", wanted, RECORD_SCHEMA)


def _emit(spark: SparkSession, state_root: str, out: str, name: str, lo: int, hi: int,
          cap: int | None, seconds: int, default_keys: Sequence[str]) -> None:
    """Roll up the windows in [lo, hi) with the batch operator and write them."""
    ms = F.unix_millis("ts")
    rows = _records(spark, state_root, lo, hi).where((ms >= lo) & (ms < hi))
    rolled = settled(rollup.rollup(rows, cap=cap, seconds=seconds, default_keys=default_keys))
    rollup.with_empty_windows(rolled, lo, hi, seconds, default_keys).write.mode(
        "overwrite"
    ).parquet(f"{out}/emitted={name}")


def start_rollup(reports: DataFrame, state_root: str, out: str, once: bool = False,
                 delay_seconds: int = 30, cap: int | None = None,
                 seconds: int = WINDOW_SECONDS, round_seconds: int = 30,
                 default_keys: Sequence[str] = DEFAULT_KEYS, ahead_seconds: int = AHEAD_SECONDS,
                 clock: Callable[[int], str] = utc_now) -> StreamingQuery:
    """SNK4: zero-filled rollup of closed windows, exactly once; all records unless a cap is given.

    Micro-batches stage their records by hour; a window is rolled up by the batch
    operator when the newest record is ``delay_seconds`` past its end. Records of
    windows already closed go to ``state_root/late``, unreadable ones to
    ``state_root/quarantine``, and so do those stamped more than ``ahead_seconds`` after the
    batch's own time: one clock that runs ahead would close the windows of all others.
    The batch is read once. Every folder belongs to one micro-batch, so replays
    overwrite what they wrote.
    """
    step = seconds * 1000

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            one_batch(batch, batch_id)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = _closed_before(session, state_root, batch_id)
        limit = clock_ms(batch_clock(session, state_root, batch_id, clock)) + ahead_seconds * 1000
        ms = F.unix_millis("ts")
        known = settled(telemetry.parse(batch).withColumn("seq", F.monotonically_increasing_id()))
        fault = (
            F.when(F.col("ts").isNull(), "no_time").when(~F.col("report_ok"), "unreadable")
            .when(ms > limit, "future_time")
        )
        known = known.withColumn("fault", fault)
        good = telemetry.good_reports(known.where("fault IS NULL").drop("fault")).drop("value")
        late = F.lit(False) if before is None else ms < before
        staged = good.withColumns(
            {"hour": F.floor(ms / F.lit(HOUR_MS)).cast("bigint"), "batch_id": F.lit(batch_id)}
        )
        (
            staged.where(~late).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("hour", "batch_id").parquet(f"{state_root}/records")
        )
        good.drop("seq").where(late).write.mode("overwrite").parquet(f"{state_root}/late/batch_id={batch_id}")
        known.where("fault IS NOT NULL").select("ts", "value", "fault").write.mode(
            "overwrite"
        ).parquet(f"{state_root}/quarantine/batch_id={batch_id}")
        bounds = good.where(~late).agg(F.min(ms), F.max(ms)).first()
        lo = before
        closed = before
        if bounds[0] is not None:
            lo = bounds[0] // step * step if before is None else before
            closed = max(lo, (bounds[1] - delay_seconds * 1000) // step * step)
            if closed > lo:
                _emit(session, state_root, out, str(batch_id), lo, closed, cap, seconds,
                      default_keys)
        session.createDataFrame([(closed,)], "closed_ms bigint").write.mode("overwrite").parquet(
            f"{state_root}/progress/batch_id={batch_id}"
        )

    writer = reports.writeStream.foreachBatch(on_batch).option(
        "checkpointLocation", f"{state_root}/checkpoint"
    )
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{round_seconds} seconds").start()


def finish_rollup(spark: SparkSession, state_root: str, out: str, cap: int | None = None,
                  seconds: int = WINDOW_SECONDS,
                  default_keys: Sequence[str] = DEFAULT_KEYS) -> None:
    """Roll up what is still open after the stream has ended for good."""
    step = seconds * 1000
    closed = spark.read.parquet(f"{state_root}/progress").agg(F.max("closed_ms")).first()[0]
    # Whole hours before the last closed window can't hold an open one.
    newest = _records(spark, state_root, closed).agg(F.max(F.unix_millis("ts"))).first()[0]
    if newest is not None:
        _emit(spark, state_root, out, "final", closed, (newest // step + 1) * step, cap, seconds,
              default_keys)


def emitted(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("emitted")
