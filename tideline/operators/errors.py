"""AGG8: all values of a group, or all its errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.joins import join_keyed


def group_verdicts(rows: DataFrame, keys: Sequence[str], ok: str = "name_ok") -> DataFrame:
    """One row per group: counts of values and errors, valid iff no error."""
    return rows.groupBy(*keys).agg(
        F.count_if(ok).alias("n_values"),
        F.count_if(~F.col(ok)).alias("n_errors"),
    ).withColumn("is_valid", F.col("n_errors") == 0)


def collapse(rows: DataFrame, keys: Sequence[str], ok: str = "name_ok") -> DataFrame:
    """Rows of valid groups, and only the error rows of the others.

    The combined value or error stays a set of rows: nothing is collected into
    one list, however many files a day directory holds.
    """
    verdicts = group_verdicts(rows, keys, ok).select(*keys, "is_valid")
    return join_keyed(rows, verdicts, list(keys), "inner").where(
        F.col("is_valid") | ~F.col(ok)
    )
