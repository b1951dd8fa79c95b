"""Packing pieces into sequences of fixed length: cutting stock by column generation."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import running_total, settled


def best_pattern(widths: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over ``room``: value and number of each width."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(widths, kind="stable")
    w, v = widths[order], values[order]
    fits = np.searchsorted(w, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if fits[c]:
            got = v[:fits[c]] + best[c - w[:fits[c]]]
            k = int(np.argmax(got))
            if got[k] > best[c] + 1e-12:
                best[c], took[c] = got[k], order[k]
    counts, c = np.zeros(len(widths), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= widths[took[c]]
    return float(best[room]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchange. The matrices here have at most capacity / grain rows, for
    which a threaded linear-algebra library in the driver is no gain and may starve the JVM."""
    n = len(matrix)
    a = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        best = k + int(np.argmax(np.abs(a[k:, k])))
        a[[k, best]] = a[[best, k]]
        a[k] /= a[k, k]
        factor = a[:, k].copy()
        factor[k] = 0
        a -= factor[:, None] * a[k]
    return a[:, n:]


def column_generation(widths: np.ndarray, demand: np.ndarray, room: int, gap: float = 5e-4):
    """Fractional optimum of the cutting-stock program: patterns (rows) and how often each is used.

    The basis begins with one pattern per width; each round prices a new pattern by the
    knapsack and exchanges it. Ends when no pattern helps or a lower bound (by volume, or by the
    prices scaled to be feasible) is within ``gap``.
    """
    m = len(widths)
    basis = np.diag(room // widths).astype(float)
    used = demand / np.diag(basis)
    inverse = inverted(basis)
    bound = float((demand * widths).sum()) / room
    for turn in range(60 * m):
        prices = inverse.sum(0)
        value, column = best_pattern(widths, np.maximum(prices, 0), room)
        bound = max(bound, used.sum() / value)
        if value <= 1 + 1e-9 or used.sum() <= bound * (1 + gap):
            break
        step = (inverse * column).sum(1)
        ratio = np.full(m, np.inf)
        np.divide(used, step, out=ratio, where=step > 1e-9)
        out = int(np.argmin(ratio))
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        basis[:, out] = column
        if turn % 64 == 63:
            inverse = inverted(basis)
            used = np.maximum((inverse * demand).sum(1), 0)
        else:
            row = inverse[out] / step[out]
            inverse -= step[:, None] * row
            inverse[out] = row
    return basis.T.round().astype(np.int64), used


def fill(left: Counter, room: int) -> list[int]:
    """The largest width left, and of the others those that fill the rest best (subset sums)."""
    items = [max(left)]
    rest = left - Counter(items)
    room -= items[0]
    widths = [w for w, n in sorted(rest.items(), reverse=True) if w <= room for _ in range(min(n, room // w))]
    reach = [1]
    mask = (1 << (room + 1)) - 1
    for w in widths:
        reach.append((reach[-1] | reach[-1] << w) & mask)
        if reach[-1] >> room & 1:
            break
    at = reach[-1].bit_length() - 1
    for k in range(len(reach) - 1, 0, -1):
        if not reach[k - 1] >> at & 1:
            items.append(widths[k - 1])
            at -= widths[k - 1]
    return items


def plan(histogram: dict[int, int], room: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns, as (width, number) pairs, with how many sequences use each; meets every demand exactly.

    The rounded-down program takes nearly all; what rounding leaves (under one sequence per
    width) is packed by :func:`fill`.
    """
    plans: Counter = Counter()
    left = Counter({w: n for w, n in histogram.items() if n > 0})
    if left:
        widths = np.array(sorted(left))
        patterns, used = column_generation(widths, np.array([left[w] for w in widths], float), room)
        for pattern, times in sorted(zip(patterns.tolist(), np.floor(used + 1e-7).astype(int).tolist()), reverse=True):
            mine = {int(w): n for w, n in zip(widths, pattern) if n}
            times = min([times, *(left[w] // n for w, n in mine.items())])
            if times > 0 and mine:
                plans[tuple(sorted(mine.items()))] += times
                for w, n in mine.items():
                    left[w] -= n * times
        left = +left
        while left:
            items = Counter(fill(left, room))
            times = min(left[w] // n for w, n in items.items())
            plans[tuple(sorted(items.items()))] += times
            for w, n in items.items():
                left[w] -= n * times
            left = +left
    return sorted(plans.items())


def pack(pieces: DataFrame, key: list[str], length: str = "length", capacity: int = 2048,
         grain: int = 16) -> DataFrame:
    """Give each piece a place: adds ``sequence_id`` and ``offset``, keeps all other columns.

    Input columns of these two names are replaced; no other name of a column matters.
    ``key`` orders the pieces of a width; rows equal in all of it are interchangeable. Every
    ``length`` must be from 1 to ``capacity``. Widths are lengths in units of ``grain``, rounded up, so
    the histogram has at most capacity / grain rows; it and the patterns made from it are all
    that the driver sees, whatever the number of pieces. A piece's rank among those of its
    width says which sequence it goes to. Offsets have no gaps. An empty table stays empty.
    """
    room = capacity // grain
    # The row travels as one value, so that none of its columns meets one of those used here.
    order = [f"key{i}" for i in range(len(key))]
    wide = settled(pieces.select(
        F.struct("*").alias("row"), F.ceil(F.col(length) / grain).cast("int").alias("width"),
        F.lit(1).cast("long").alias("one"), *[F.col(k).alias(o) for k, o in zip(key, order)]))
    histogram = {r["width"]: r["n"] for r in wide.groupBy("width").agg(F.count("*").alias("n")).collect()}
    if histogram and (min(histogram) < 1 or max(histogram) > room):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    # For each (width, pattern): the first global rank, pieces per sequence, first sequence, first slot.
    first, total = {}, 0
    for w in sorted(histogram):
        first[w] = total
        total += histogram[w]
    rows, sequence = [], 0
    for pattern, times in plan(histogram, room):
        slot = 0
        for w, n in pattern:
            rows.append((first[w], n, sequence, slot))
            first[w] += n * times
            slot += n
        sequence += times
    rows.sort()
    low, per, base, slots = (np.array(x, np.int64) for x in (zip(*rows) if rows else ([], [], [], [])))

    @F.pandas_udf("sequence_id long, slot long")
    def place(rank: pd.Series) -> pd.DataFrame:
        r = rank.to_numpy(np.int64)
        k = np.searchsorted(low, r, "right") - 1
        nth = r - low[k]
        return pd.DataFrame({"sequence_id": base[k] + nth // per[k], "slot": slots[k] + nth % per[k]})

    ranked = running_total(wide, ["width", *order], "one", "rank").select("row", place("rank").alias("place"))
    placed = ranked.select("row", "place.sequence_id", "place.slot", F.col("row").getField(length).alias("filled"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    kept = [F.col("row").getField(c).alias(c) for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    return (placed.withColumn("offset", F.coalesce(F.sum("filled").over(before), F.lit(0)).cast("long"))
            .select(*kept, "sequence_id", "offset"))
