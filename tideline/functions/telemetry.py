"""Telemetry text ``service category key value``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys reported as zero when nothing arrived for them, oldest first.
DEFAULT_KEYS = (
    "files_to_ship",
    "failed_to_get_sync_list",
    "rotated_during_ship",
    "lost_during_ship",
)


def parse(df: DataFrame, value: str = "value") -> DataFrame:
    """PRJ10: add service, category, key, amount and ``report_ok``.

    Short or non-numeric records have ``report_ok`` false and belong in a
    quarantine table; words after the fourth are ignored.
    """
    words = F.split(F.trim(F.regexp_replace(F.col(value), r"\s+", " ")), " ", -1)
    amount = F.get(words, F.lit(3)).try_cast("int")
    return df.withColumns(
        {
            "service": F.get(words, F.lit(0)),
            "category": F.get(words, F.lit(1)),
            "key": F.get(words, F.lit(2)),
            "amount": amount,
            "report_ok": amount.isNotNull(),
        }
    )


def good_reports(df: DataFrame) -> DataFrame:
    return df.where("report_ok").drop("report_ok")


def bad_reports(df: DataFrame) -> DataFrame:
    return df.where("NOT report_ok").select("ts", "value")


def key_value(df: DataFrame) -> DataFrame:
    """PRJ12: reduce a record to (key, amount)."""
    return df.select("key", "amount")
