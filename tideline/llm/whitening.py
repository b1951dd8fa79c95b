"""Whitening of embeddings by shifted CholeskyQR.

Vectors become whole numbers, so that sums over all rows are exact. Each pass takes the Gram matrix
of centred rows that are already turned by the triangular factors found so far, and adds one more
factor; the first factor is of a Gram matrix shifted enough to have one however ill-conditioned
the rows are. The factors' product R has the singular values and right singular vectors of the
centred rows, with no square of a condition number on the way.

The driver sees sums over all rows and matrices of dimension x dimension, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.vectors import matrix

#: Passes: one with a shift, two without.
PASSES = 3
#: Directions with at most this share of the largest standard deviation are none.
FLAT = 1e-13
#: Rows turned at a time within a task.
BLOCK = 4096


class Whitening(NamedTuple):
    """What is learned: ``rows`` and exact ``sums``; per component its ``directions`` row, ``variance`` and ``explained`` share."""

    rows: int
    sums: np.ndarray
    directions: np.ndarray
    variance: np.ndarray
    explained: np.ndarray


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` (array of long) of rows with a vector that has only finite entries, and at least one."""
    entries = F.col(column).cast("array<double>")
    return (df.select("vec_id", entries.alias("v"))
            .where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size("v") > 0))
            .select("vec_id", F.transform("v", lambda c: F.floor(c * 64) + 1_000_000).alias("x")))


def totals(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums per dimension. All vectors must be equally long."""
    shape = vectors.select(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).first()
    if not shape["n"]:
        return 0, np.zeros(0, np.int64)
    if shape["low"] != shape["high"]:
        raise ValueError(f"vectors of {shape['low']} to {shape['high']} dimensions")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape["high"], np.int64)
        for batch in batches:
            sums += matrix(batch.column(0)).astype(np.int64).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["d", "s"])

    found = vectors.select("x").mapInArrow(add, "d int, s long").groupBy("d").agg(F.sum("s").alias("s")).collect()
    return shape["n"], np.array([r["s"] for r in sorted(found)], np.int64)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, each entry rounded once."""
    return (x * n - sums) / n


def turned(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverse of each upper triangular factor in turn, solved column by column."""
    for r in factors:
        q = np.empty_like(y)
        for j in range(r.shape[1]):
            q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        y = q
    return y


def gram(vectors: DataFrame, form: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of z' z over the rows z = form(x): summed in tasks, then one row of the matrix at a time."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                z = form(matrix(batch.column(0).slice(at, BLOCK)))
                total += z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, TaskContext.get().partitionId()), pa.int32()), pa.array(range(size), pa.int32()),
             pa.array(list(total), pa.list_(pa.float64()))], names=["task", "line", "sums"])

    def add(lines: pa.Table) -> pa.Table:
        # In the order of tasks, so that reruns give the same bits.
        lines = lines.sort_by("task")
        sums = matrix(lines.column("sums")).sum(0)
        return pa.table({"line": lines.column("line").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    parts = vectors.select("x").mapInArrow(part, "task int, line int, sums array<double>")
    lines = parts.groupBy("line").applyInArrow(add, "line int, sums array<double>").collect()
    return np.array([r["sums"] for r in sorted(lines)], float).reshape(size, size)


def cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper triangular R with R'R = a, and which columns depend on no earlier one.

    Where a column does depend on earlier ones its pivot is no more than rounding; it gets a row of
    the unit matrix, which leaves the rest of the column as it is.
    """
    d = len(a)
    r, own = np.eye(d), np.ones(d, bool)
    for j in range(d):
        free = own[:j]
        pivot = a[j, j] - (r[:j, j][free] ** 2).sum()
        if pivot <= 1e-13 * max(a[j, j], 0.0):
            own[j], r[j, j + 1:] = False, 0.0
            continue
        r[j, j] = np.sqrt(pivot)
        r[j, j + 1:] = (a[j, j + 1:] - r[:j, j][free] @ r[:j, j + 1:][free]) / r[j, j]
    return r, own


def fit(vectors: DataFrame, components: int) -> Whitening:
    """Components of the covariance (divisor n) of ``usable`` vectors, by falling variance.

    At most ``components`` of them, and only those along which the vectors differ: of equal
    vectors, or none, there are no components.
    """
    n, sums = totals(vectors)
    d = len(sums)
    factors: list[np.ndarray] = []
    whole, own = np.eye(d), np.ones(d, bool)
    for turn in range(PASSES if n else 0):
        g = gram(vectors, lambda x, f=tuple(factors): turned(centred(x, n, sums), list(f)), d)
        if not turn and not np.trace(g):
            own[:] = False
            break
        # Trace is at least the largest eigenvalue of the Gram matrix, and at most d of it.
        shift = 0.0 if turn else 11 * (d * n + d * (d + 1)) * 2.0 ** -53 * np.trace(g)
        shift = min(shift, 1e-3 * np.trace(g) / d)
        r, found = cholesky(g + shift * np.eye(d))
        factors.append(r)
        own &= found
        whole = r @ whole
    # A dependent column has no direction of its own: its row of the product stands for rounding.
    _, spread, directions = np.linalg.svd(whole[own]) if own.any() else (None, np.zeros(0), np.zeros((0, d)))
    directions = directions[:len(spread)]
    variance = spread ** 2 / max(n, 1)
    share = variance / variance.sum() if len(variance) else variance
    some = np.flatnonzero(spread > FLAT * spread.max())[:components] if len(spread) else np.zeros(0, int)
    return Whitening(n, sums, directions[some], variance[some], share[some])


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows along each component, in standard deviations."""
    return centred(x, model.rows, model.sums) @ (model.directions / np.sqrt(model.variance)[:, None]).T


def deviation(x: np.ndarray, model: Whitening) -> list[int]:
    """Sum over dimensions of (n x - sums)^2, exact."""
    away = x * model.rows - model.sums
    if not away.size or np.abs(away).max() < np.sqrt(2.0 ** 62 / away.shape[1]):
        return (away * away).sum(1).tolist()
    return [sum(v * v for v in row) for row in away.tolist()]


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on all rows."""
    k = len(model.variance)
    if not k:
        return 0.0
    return float(np.abs(gram(vectors, lambda x: whitened(x, model), k) / model.rows - np.eye(k)).max())


def transform(vectors: DataFrame, model: Whitening, error: float) -> DataFrame:
    """A row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is a decimal, as it may pass the range of a long.
    """
    k = len(model.variance)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if k else 0, BLOCK):
                batch = whole.slice(at, BLOCK)
                x, rows = matrix(batch.column(1)), batch.num_rows
                each = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, model.rows)),
                     pa.array([str(v) for v in deviation(x, model)]).take(pa.array(each)),
                     pa.array(whitened(x, model).ravel()), pa.array(np.tile(model.explained, rows)),
                     pa.array(np.full(rows * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    out = vectors.select("vec_id", "x").mapInArrow(
        apply, f"vec_id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(embeddings: DataFrame, components: int = 32) -> DataFrame:
    """Rows of ``transform`` for all vectors of ``embeddings`` (``vec_id``, ``embedding``).

    Vectors that are null, empty or hold null or non-finite entries are left out; a null ``vec_id``
    and repeated rows stay as they are, each a row of its own. Vectors of different lengths
    are an error. Where the vectors differ along fewer directions than ``components``, only
    those come; equal vectors, one vector or an empty table give no rows. Equal variances
    come in the order of the decomposition, the same for all rows. Other columns are ignored.
    """
    vectors = usable(embeddings)
    model = fit(vectors, components)
    return transform(vectors, model, identity_error(vectors, model))
