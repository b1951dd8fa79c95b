"""One aggregator round over all services: plan, select, merge, publish, retain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import names, predicates
from tideline.operators import inventory, retention
from tideline.operators.inventory import DIR_KEYS, MAX_LOOK_BACK_DAYS
from tideline.operators.joins import join_keyed, settled
from tideline.plans import catalogue, compact, problems, retain, runlog, ship
from tideline.session import qualified, scratch_dir
from tideline.sources import archive, files, index


@dataclass
class Round:
    plan: DataFrame
    units: DataFrame
    outstanding: DataFrame
    published: bool
    known: index.Index | None = None


# Folders of one round that are named one by one; with more, the spool is read as a whole.
MAX_FOLDERS = 20_000


def shipping_folders(spool: str, units: DataFrame) -> str | list[str]:
    """The folders of the units: those of throttled and finished directories are not opened.

    One path per directory, whatever its files. Names that a path pattern would read
    otherwise make it the whole spool.
    """
    key = names.destination_key(F.col("service"), F.col("category"), F.col("host"))
    found = [r[0] for r in units.select(key).distinct().limit(MAX_FOLDERS + 1).collect()]
    if len(found) > MAX_FOLDERS or any(set(name) & set("{}[]*?\\,^") for name in found):
        return spool
    return [f"{spool}/{name}" for name in found]


def indexed(spark: SparkSession, spool: str,
            exclude: Sequence[str] = predicates.HIDDEN_FILES) -> index.Index:
    """The spool as it is now, for a round that no other round came before."""
    return index.advance(spark, spool, scratch_dir(spark, "index"), 0, exclude)


def problems_of(spool: index.Index, plan: DataFrame, todo: DataFrame, parsed: DataFrame) -> DataFrame:
    """JOB10: what each stage of a round could not use."""
    named = spool.dirs.where("n_bad_names > 0").select("dir_name")
    return problems.together(
        problems.bad_directories(spool.dirs), problems.unlisted_directories(spool.dirs),
        problems.bad_file_names(spool.files(named).where("dir_ok")), problems.bad_archive_names(parsed),
        problems.not_shipping(plan), problems.nothing_left(ship.nothing_to_sync(plan, todo)),
    )


def run_round(spark: SparkSession, spool: str, archive_root: str, as_of: str, round_id: str,
              listing: DataFrame | None = None,
              interval_seconds: int | Column = ship.SHIP_INTERVAL_SECONDS,
              max_ready_bytes: int | Column = ship.MAX_READY_BYTES,
              max_look_back_days: int = MAX_LOOK_BACK_DAYS,
              shard_bytes: int = compact.SHARD_BYTES,
              parity: bool = False, known: index.Index | None = None,
              exclude: Sequence[str] = predicates.HIDDEN_FILES, strict: bool = False,
              log: runlog.Phases | None = None) -> Round:
    """JOB1 to JOB3 and the publish, on ``spool/<service@category@host>/<file>``.

    The spool is walked, or ``known`` gives an index of it, or ``listing`` an inventory (then
    no problems of names are recorded). Plans rest on one row per directory; files are read of
    shipping directories only. Bad directories, labels and archive names, directories that could
    not be listed and those that were held back are kept under ``archive_root/problems``; with
    ``strict`` the first bad label or archive name fails the round. The archive's own ledger
    keeps repeated rounds from shipping a file twice; ``parity`` relies on the look-back alone.
    """
    log = log or runlog.Phases()
    days = files.lookback_days(as_of, max_look_back_days)
    with log.phase("plan"):
        parsed = names.with_archive_fields(archive.catalogue(spark, archive_root, days).select("dir_date", "file_name"))
        taken = catalogue.strict(parsed) if strict else catalogue.good(parsed)
        if listing is None:
            known = known or indexed(spark, spool, exclude)
            state = inventory.with_lookback(known.state(), as_of, max_look_back_days).drop("dir_name")
        else:
            usable = settled(inventory.usable(listing.select(*DIR_KEYS, "file_name", "size_bytes"), exclude, strict))
            state = inventory.directory_state(usable, as_of, max_look_back_days)
        plan = settled(ship.plan_of_state(state, taken, as_of, interval_seconds, max_ready_bytes, max_look_back_days))
        if listing is None:
            key = names.destination_key(*[F.col(k) for k in DIR_KEYS])
            due = known.files(plan.where("ships").select(key.alias("dir_name")))
            usable = inventory.usable(due.select(*DIR_KEYS, "file_name", "size_bytes"), exclude, strict)
        since_age_limit = files.lookback_days(as_of, max_look_back_days + 1)
        todo = ship.outstanding(usable, plan, as_of, max_look_back_days)
        if not parity:
            todo = archive.unpublished(todo, archive_root, since_age_limit)
        todo = settled(todo)
        units = settled(compact.batches(todo, shard_bytes))
        if listing is None:
            problems.record(problems_of(known, plan, todo, parsed), archive_root, round_id, as_of)
    published = False
    if units.limit(1).count():
        with log.phase("ship"):
            # Exactly the planned files: one that appeared since waits for the next round.
            key = names.destination_key(*[F.col(k) for k in DIR_KEYS])
            path = F.concat_ws("/", F.lit(qualified(spark, spool)), key, "file_name")
            planned = files.lines_of(todo.dropDuplicates([*DIR_KEYS, "file_name"]).withColumn("path", path))
            merged = compact.merged_lines(planned, units, as_of, shard_bytes)
            sources = join_keyed(todo, units.select(*DIR_KEYS, "archive_name"), DIR_KEYS, "inner")
            published = archive.publish(merged, units, sources, archive_root, round_id, as_of)
    return Round(plan, units, todo, published, known)


def retention_after(spark: SparkSession, spool: str, done: Round, as_of: str,
                    min_bytes: int | Column = 1024 * 1024) -> DataFrame:
    """JOB4 of the same round: the written manifest with file paths, nothing deleted yet."""
    found = files.rotated_files(spark, spool).where("dir_ok").drop("dir_ok", "dir_name")
    found = settled(inventory.usable(found))
    units = done.units if done.published else done.units.limit(0)
    return settled(retain.retention_manifest(found, units, as_of, min_bytes))


def retention_of(known: index.Index, archive_root: str, round_id: str, as_of: str,
                 min_bytes: int | Column = retention.MIN_BYTES,
                 max_look_back_days: int = MAX_LOOK_BACK_DAYS) -> DataFrame:
    """JOB4 of a round over an index: after what it published, and after all else, what may go.

    What the round published comes from the catalogue, so a replay after a crash decides the
    same. Files are read only of directories that hold one older than their limit.
    """
    spark = known.spark
    units = archive.catalogue(spark, archive_root, [as_of[:10]]).where(F.col("publish_id") == round_id)
    totals = known.state().withColumnRenamed("ready_bytes", "total_bytes")
    limits = settled(retain.limits_of(totals, units, as_of, max_look_back_days))
    old = limits.where("first_label < limit_label AND n_files > 1")
    found = settled(known.files(old.select("dir_name")).where("label IS NOT NULL").drop("dir_ok", "dir_name"))
    return settled(retention.manifest(found, old.drop("dir_name", "first_label", "last_label", "n_files"),
                                      DIR_KEYS, min_bytes))
