"""Agent side set operations: what the server holds, what is worth sending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import predicates
from tideline.operators.joins import join_keyed

AGENT = ["agent"]


def without_names(listing: DataFrame, exclusions: DataFrame) -> DataFrame:
    """SET1: listing EXCEPT exclusion names, one occurrence per exclusion row.

    Multiset difference per agent: every name is numbered within equal names, and
    equal (agent, name, number) cancel. ``exclusions`` is a list of names that
    holds for each agent.
    """
    counts = exclusions.groupBy("file_name").agg(F.count(F.lit(1)).alias("_drop"))
    grouped = listing.groupBy("agent", "file_name").agg(F.count(F.lit(1)).alias("_n"))
    left = join_keyed(grouped, counts, ["file_name"], "left").withColumn(
        "_n", F.col("_n") - F.coalesce("_drop", F.lit(0))
    )
    return left.where("_n > 0").select(
        "agent", "file_name", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i")
    ).drop("_i")


def missing_members(small: DataFrame, big: DataFrame, on: Sequence[str]) -> DataFrame:
    """JN3: rows of ``small`` with no partner in ``big``; duplicates stay."""
    return small.join(big.select(*on), list(on), "left_anti")


def on_server(local: DataFrame, missing: DataFrame) -> DataFrame:
    """JN5: local files the dry run did not ask for, so the server has them."""
    return local.join(missing.select("agent", "file_name"), ["agent", "file_name"], "left_anti")


def server_high_marks(local: DataFrame, missing: DataFrame) -> DataFrame:
    """AGG4: greatest file the server already holds, per agent."""
    return on_server(local, missing).groupBy(*AGENT).agg(F.max("file_name").alias("high_mark"))


def beyond_gap(local: DataFrame, missing: DataFrame) -> DataFrame:
    """SET2: missing files later than everything the server holds.

    Nothing on the server: all missing files. The anti-join is keyed on
    (agent, file_name) and spreads a busy agent; only one row per agent is joined
    back.
    """
    marks = server_high_marks(local, missing)
    return (
        join_keyed(missing, marks, AGENT, "left")
        .where(F.col("high_mark").isNull() | (F.col("file_name") > F.col("high_mark")))
        .drop("high_mark")
    )


def sync_candidates(listing: DataFrame, parity_exclusions: bool = False) -> DataFrame:
    """JOB5 on a listing of all agents with ``side`` local / missing."""
    name = F.col("file_name")
    local = listing.where(
        (F.col("side") == "local") & ~predicates.agent_excluded(name, parity_exclusions)
    ).select("agent", "file_name")
    missing = listing.where(
        (F.col("side") == "missing")
        & predicates.names_rotated_file(name)
        & ~predicates.agent_excluded(name)
    ).select("agent", "file_name")
    return beyond_gap(local, missing)


def ship_statistics(attempts: DataFrame, after: DataFrame,
                    file_keys: Sequence[str] = ("file_name",)) -> DataFrame:
    """AGG7 / JOB6: per agent and cycle what was tried, rotated away and lost.

    ``num_shipped`` counts attempts, lost ones included; ``num_delivered`` those
    that succeeded. A failed file that still exists aborts its cycle: the row then
    has ``aborted`` set and is not a statistic to report. ``file_keys`` tell the files
    of a cycle apart, where one name came up more than once.
    """
    keys = ["agent", "cycle", *file_keys]
    present = after.groupBy(*keys).agg(F.lit(True).alias("_present"))
    flagged = attempts.join(present, keys, "left").withColumn("_gone", F.col("_present").isNull())
    return flagged.groupBy("agent", "cycle").agg(
        F.count(F.lit(1)).alias("num_shipped"),
        F.count_if("ok").alias("num_delivered"),
        F.count_if("_gone").alias("num_rotated"),
        F.count_if(~F.col("ok") & F.col("_gone")).alias("num_lost"),
        F.max(~F.col("ok") & ~F.col("_gone")).alias("aborted"),
    )
