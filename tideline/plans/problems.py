"""JOB10: everything a round could not use, with where it comes from, in one table.

Each stage of a round gives its problems as rows of :data:`COLUMNS`; what is fatal is somebody's to
mend, the rest explains why nothing was shipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import names
from tideline.operators.inventory import DIR_KEYS
from tideline.session import read_folders

COLUMNS = [*DIR_KEYS, "dir_name", "file_name", "error_kind", "error_detail", "is_fatal"]
SCHEMA = (
    "service string, category string, host string, dir_name string, file_name string, error_kind string, "
    "error_detail string, is_fatal boolean, at timestamp, round_id string"
)
# Not a fault of the data: they pass by themselves.
PASSING = ("sync_throttled", "nothing_to_sync")


def _rows(df: DataFrame, kind: str | Column, detail: Column) -> DataFrame:
    """Rows of COLUMNS; identity columns that ``df`` does not have are null."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    have = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in COLUMNS[:5]}
    return df.select(
        *[c.alias(name) for name, c in have.items()], kind.alias("error_kind"),
        detail.alias("error_detail"), (~kind.isin(*PASSING)).alias("is_fatal"))


def bad_directories(dirs: DataFrame) -> DataFrame:
    """Directories whose names are no service, category and host."""
    rows = names.with_service_identity(dirs).where("NOT dir_ok")
    return _rows(rows, "bad_directory", F.concat(F.lit("no service directory: "), F.col("dir_name")))


def unlisted_directories(dirs: DataFrame) -> DataFrame:
    """Directories that could not be listed (``error``)."""
    rows = names.with_service_identity(dirs).where("error IS NOT NULL")
    return _rows(rows, "listing_failed", F.col("error"))


def bad_file_names(files: DataFrame) -> DataFrame:
    """Files of service directories (enriched inventory) without a label."""
    return _rows(files.where("label IS NULL"), "invalid_name", F.concat(F.lit("no label in "), F.col("file_name")))


def bad_archive_names(parsed: DataFrame) -> DataFrame:
    """Archive files of which no service can be told; ``dir_name`` is their day."""
    rows = parsed.where("NOT name_ok").select("file_name", names.day_path(F.col("dir_date")).alias("dir_name"))
    return _rows(rows, "invalid_archive_name", F.concat(F.lit("no archive name: "), F.col("file_name")))


def not_shipping(plan: DataFrame) -> DataFrame:
    """Directories the plan holds back, by the plan's own error kind."""
    rows = plan.where("error_kind IS NOT NULL")
    return _rows(rows, F.col("error_kind"), F.concat(F.lit("last shipped "), F.coalesce("last_taistamp", F.lit("never"))))


def nothing_left(due: DataFrame) -> DataFrame:
    """Directories that were due and had no file left, as ``ship.nothing_to_sync`` gives them."""
    return _rows(due, "nothing_to_sync", F.lit("no file newer than the last shipped"))


def together(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def record(found: DataFrame, root: str, round_id: str, as_of: str) -> None:
    """Keep the problems of a round; a replay overwrites its own."""
    found.select(*COLUMNS, F.lit(as_of).cast("timestamp").alias("at")).write.mode("overwrite").parquet(
        f"{root}/problems/round_id={round_id}")


def recorded(spark: SparkSession, root: str) -> DataFrame:
    """Problems of all rounds."""
    return read_folders(spark, f"{root}/problems", "round_id", lambda _: True, SCHEMA)


def report(found: DataFrame) -> DataFrame:
    """Fatal problems per service and kind; of files and directories without a service the service is null."""
    return found.where("is_fatal").groupBy("service", "error_kind").agg(
        F.count(F.lit(1)).alias("n_errors"), F.count_distinct("dir_name").alias("n_directories"))
