"""STR1 / STR3 / STR4 / STR7: continuous ship rounds over a spool directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tideline.functions import predicates
from tideline.operators import retention
from tideline.operators.inventory import DIR_KEYS, MAX_LOOK_BACK_DAYS
from tideline.plans import compact, rounds, runlog, ship
from tideline.session import matching_paths, read_folders, scratch_scope
from tideline.sources import archive, index

def utc_now(batch_id: int) -> str:
    """The clock of a live stream, read once per round on the driver."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")[:-3]


def stream_name(spark: SparkSession, state_root: str) -> str:
    """The name of a stream's state folder, given once: batch numbers begin anew in each."""
    path = f"{state_root}/name"
    if not matching_paths(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame([(uuid.uuid4().hex,)], "name string").write.mode(
            "overwrite").parquet(path)
    return spark.read.parquet(path).first()["name"]


def batch_clock(spark: SparkSession, state_root: str, batch_id: int,
                clock: Callable[[int], str]) -> str:
    """The time of a micro-batch, kept so that its replay has the same."""
    path = f"{state_root}/clock/batch_id={batch_id}"
    if not matching_paths(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame([(clock(batch_id),)], "as_of string").write.mode(
            "overwrite").parquet(path)
    return spark.read.parquet(path).first()["as_of"]


def start_shipping(spark: SparkSession, spool: str, archive_root: str, state_root: str,
                   clock: Callable[[int], str] = utc_now, once: bool = False,
                   round_seconds: int = 60,
                   interval_seconds: int | Column = ship.SHIP_INTERVAL_SECONDS,
                   max_ready_bytes: int | Column = ship.MAX_READY_BYTES,
                   max_look_back_days: int = MAX_LOOK_BACK_DAYS,
                   shard_bytes: int = compact.SHARD_BYTES,
                   exclude: Sequence[str] = predicates.HIDDEN_FILES, strict: bool = False,
                   delete: bool = False, min_bytes: int | Column = retention.MIN_BYTES) -> StreamingQuery:
    """Ship by size or time, whichever comes first, until stopped.

    Each micro-batch is one round: the index of the spool is brought up to date, which lists only
    directories that changed, what is due is shipped, and with ``delete`` retention removes
    what may go, after a shipment and after none, as long as ``min_bytes`` of a directory stay.
    Rounds happen whether files arrive or not, since a held-back file may become due by time alone.

    A replayed micro-batch overwrites its own folders of the index, takes the time of its first run and
    finds its publish id committed, so nothing is shipped twice. Publish ids carry the stream's own
    name, so a stream with a new state folder ships what the archive's ledger does not have.

    Kept under ``state_root``: ``index``, ``late`` (files that can never ship), ``removed`` (what retention
    named), ``runs`` (phases and their times); under ``archive_root``: ``problems``.
    """
    name = stream_name(spark, state_root)
    # One row, and so one round, per trigger.
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            one_round(batch.sparkSession, batch_id)

    def one_round(session: SparkSession, batch_id: int) -> None:
        as_of = batch_clock(session, state_root, batch_id, clock)
        round_id, log, runs = f"{name}-{batch_id}", runlog.Phases(), f"{state_root}/runs/batch_id={batch_id}"
        with log.phase("round"):
            log.write(session, runs)
            with log.phase("list"):
                known = index.advance(session, spool, f"{state_root}/index", batch_id, exclude)
            done = rounds.run_round(
                session, spool, archive_root, as_of, round_id, None, interval_seconds, max_ready_bytes,
                max_look_back_days, shard_bytes, known=known, exclude=exclude, strict=strict, log=log,
            )
            fresh = known.fresh.where("dir_ok AND label IS NOT NULL").select(*DIR_KEYS, "file_name", "size_bytes", "label")
            ship.late_files(fresh, done.plan, as_of, max_look_back_days).write.mode(
                "overwrite"
            ).parquet(f"{state_root}/late/batch_id={batch_id}")
            if delete:
                with log.phase("cleanup"):
                    flagged = rounds.retention_of(known, archive_root, round_id, as_of, min_bytes, max_look_back_days)
                    flagged.where("to_delete").write.mode("overwrite").parquet(
                        f"{state_root}/removed/batch_id={batch_id}")
                    archive.delete_files(flagged)
        log.write(session, runs)

    writer = ticks.writeStream.foreachBatch(on_batch).option(
        "checkpointLocation", f"{state_root}/checkpoint"
    )
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{round_seconds} seconds").start()


def late_files(spark: SparkSession, state_root: str) -> DataFrame:
    """STR4: files that arrived too late to ever ship, with the reason."""
    return spark.read.parquet(f"{state_root}/late")


def run_log(spark: SparkSession, state_root: str) -> DataFrame:
    """AGG10: phases of all rounds, for ``plans.runlog``."""
    return read_folders(spark, f"{state_root}/runs", "batch_id", lambda _: True, f"{runlog.RUNS_SCHEMA}, batch_id bigint")
