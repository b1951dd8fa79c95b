"""Filters over file names and the ship decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN_FILES = (r"\..*",)
AGENT_NAMES = ("config", "current", "lock")
AGENT_SUFFIXES = (".u", "~")


def excluded(name: Column, patterns: Sequence[str] = HIDDEN_FILES) -> Column:
    """FLT1: the name fully matches any of the patterns."""
    if not patterns:
        return F.lit(False)
    return name.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + r")\z")


def agent_excluded(name: Column, parity_exclusions: bool = False) -> Column:
    """FLT2: names an agent never ships.

    With ``parity_exclusions`` only the fixed names are dropped from the local
    list while the transfer also skips ``*.u`` and ``*~``, so such files look as
    if the server already had them.
    """
    hit = name.isin(*AGENT_NAMES)
    if parity_exclusions:
        return hit
    for suffix in AGENT_SUFFIXES:
        hit = hit | name.endswith(suffix)
    return hit


def names_rotated_file(line: Column) -> Column:
    """FLT3: listing lines that name a rotated file."""
    return line.startswith("@")


def enough_time_past(base_ms: Column, as_of_ms: Column, seconds: int | Column) -> Column:
    """FLT7: whole elapsed seconds have reached ``seconds``."""
    return F.floor((as_of_ms - base_ms) / F.lit(1000)) >= seconds


def ship_decision(last_ms: Column, as_of_ms: Column, interval_seconds: int | Column,
                  ready_bytes: Column, max_ready_bytes: int | Column) -> Column:
    """FLT8: first / interval / size / throttled.

    A last label later than the clock never ships (its error kind is set by the
    plan). The size limit is strict.
    """
    return (
        F.when(last_ms.isNull(), "first")
        .when(last_ms > as_of_ms, "throttled")
        .when(enough_time_past(last_ms, as_of_ms, interval_seconds), "interval")
        .when(ready_bytes > max_ready_bytes, "size")
        .otherwise("throttled")
    )
