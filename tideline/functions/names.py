"""Codecs for service directory names, archive names and archive paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import labels

# Greedy on purpose: commas belong to the service, any character may precede "seq".
ARCHIVE_NAME_PATTERN = "^([0-9]{4}),([0-9]{2}),([0-9]{2}),(.*),(.*),(.*).seq$"


def with_service_identity(df: DataFrame, dir_name: str = "dir_name") -> DataFrame:
    """PRJ4: add service, category, host and ``dir_ok``.

    A name counts as three parts only when the last one is not empty: trailing
    empty parts do not exist for the naming rule.
    """
    parts = F.split(F.col(dir_name), "@", -1)
    ok = (F.size(parts) == 3) & (F.element_at(parts, -1) != "")
    return df.withColumns(
        {
            "service": F.when(ok, F.get(parts, F.lit(0))),
            "category": F.when(ok, F.get(parts, F.lit(1))),
            "host": F.when(ok, F.get(parts, F.lit(2))),
            "dir_ok": F.coalesce(ok, F.lit(False)),
        }
    )


def destination_key(service: Column, category: Column, host: Column) -> Column:
    """PRJ5: ``service@category@host``."""
    return F.concat_ws("@", service, category, host)


def with_archive_fields(df: DataFrame, file_name: str = "file_name") -> DataFrame:
    """PRJ6: add name_date, service, host, taistamp and ``name_ok``."""
    name = F.col(file_name)

    def group(i: int) -> Column:
        return F.regexp_extract(name, ARCHIVE_NAME_PATTERN, i)

    ok = F.coalesce(name.rlike(ARCHIVE_NAME_PATTERN), F.lit(False))
    day = F.concat_ws("-", group(1), group(2), group(3))
    return df.withColumns(
        {
            "name_date": F.when(ok, day.try_cast("date")),
            "service": F.when(ok, group(4)),
            "host": F.when(ok, group(5)),
            "taistamp": F.when(ok, group(6)),
            "name_ok": ok,
        }
    )


def archive_name(label: Column, service: Column, host: Column,
                 leap_table: labels.LeapTable = labels.LEAP_TABLE) -> Column:
    """PRJ7: ``YYYY,MM,DD,service,host,label.seq``; the day is the label's own."""
    day = F.date_format(labels.decode(label, leap_table), "yyyy,MM,dd")
    return F.concat_ws(",", day, service, host, F.concat(label, F.lit(".seq")))


def day_bucket(ts: Column, days_before: int = 0) -> Column:
    """PRJ8: the day ``days_before`` days before ``ts``."""
    return F.date_sub(F.to_date(ts), days_before)


def day_path(day: Column) -> Column:
    """PRJ8: archive directory of a day, ``YYYY/MM-DD``."""
    return F.date_format(day, "yyyy/MM-dd")


TEMP_PATH = "tmp/"
