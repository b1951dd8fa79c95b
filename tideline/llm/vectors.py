"""Vectors that can be compared, and those that are equal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fit(vector):
    return (F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vector, lambda x: x != 0))


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with an id whose vector is not null or zero and has only finite components, as doubles."""
    v = F.col(column).cast("array<double>")
    return (df.where(F.col("vec_id").isNotNull()).select("vec_id", v.alias("embedding"))
            .where(_fit("embedding")))


def unusable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id`` of the rows that :func:`usable` leaves out."""
    v = F.col(column).cast("array<double>")
    return (df.select("vec_id", v.alias("embedding"))
            .where(F.col("vec_id").isNull() | ~F.coalesce(_fit("embedding"), F.lit(False))).select("vec_id"))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as a matrix."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow for large or small components."""
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(1, keepdims=True))
