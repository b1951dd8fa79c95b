"""JOB10: the archive catalogue with quarantine. All problems of a round are in `problems`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import names
from tideline.operators import errors


def parse_catalogue(listing: DataFrame) -> DataFrame:
    """Every archive file with its parsed fields and ``name_ok``."""
    return names.with_archive_fields(listing)


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where("name_ok").drop("name_ok")


def quarantine(parsed: DataFrame) -> DataFrame:
    """Badly named archive files; they no longer fail whole services."""
    return parsed.where("NOT name_ok").select(
        "dir_date", "file_name",
        F.lit("invalid_name").alias("error_kind"),
        F.concat(F.lit("no archive name: "), F.col("file_name")).alias("error_detail"),
        F.lit(True).alias("is_fatal"),
    )


def day_verdicts(parsed: DataFrame) -> DataFrame:
    """AGG8 per day directory: valid, or how many errors."""
    return errors.group_verdicts(parsed, ["dir_date"])


def strict(parsed: DataFrame) -> DataFrame:
    """Fail the job on the first badly named file instead of setting it aside."""
    bad = F.raise_error(F.concat(F.lit("bad archive name: "), F.col("file_name")))
    return good(parsed.withColumn("name_ok", F.when(F.col("name_ok"), True).otherwise(bad)))
