"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import running_total, settled, words
from tideline.operators.joins import join_keyed

WEIGHTS = (5.0, 2.0, 1.0)
#: Copies are rounded on this grid, in whole numbers, so that any order of adding gives the same.
GRID = 1 << 24


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Words wanted of each source.

    ``sizes`` has ``source`` and ``source_size``. Sources in code-point order, null last, weigh
    ``weights``, repeating. They share ``share`` times all words by weight; none gets over ``most``
    times its own, and what is over is shared again until none is above. Each round freezes at
    least one source, and only sums reach the driver.
    """
    order = F.when(F.col("source").isNull(), 1).otherwise(0)
    placed = running_total(sizes.withColumn("_one", F.lit(1).cast("long")).withColumn("_null", order),
                           ["_null", "source"], "_one", "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("_place") % len(weights) + 1).cast("int"))
    placed = settled(placed.select("source", "source_size", weight.alias("weight"),
                                   (F.col("source_size") * F.lit(float(most))).alias("limit")))
    total = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words per unit of weight; rises from round to round
    while True:
        full = F.col("limit") <= F.col("weight") * F.lit(level)
        used, open_weight = placed.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)),
                                       F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        raised = (total - used) / open_weight
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return placed.select("source", "source_size",
                         F.least("limit", F.col("weight") * F.lit(level)).alias("target"))


def _key():
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("key")


def balance(counts: DataFrame, targets: DataFrame, most: float, tolerance: float = 1e-9,
            rounds: int = 100) -> DataFrame:
    """The dual of entropy balancing, solved by Newton steps: ``key``, ``full``, ``tilt``, ``mean``.

    ``counts`` has ``key``, ``size`` (over 0), ``n``; ``targets`` has ``key``, ``source_size``, ``target``. A
    document of a source gets the rate min(most, exp(tilt * size / mean size)), and the words of
    all rates must meet the target. The dual is convex with one variable per source, so its
    Hessian is diagonal: each round is one grouped sum over ``counts`` for gradient and
    curvature. A step that leaves the interval known to hold the root is replaced by the
    interval's middle, so it always converges. A source whose target is its limit takes every
    document at ``most``.
    """
    means = counts.groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = settled(targets.where("source_size > 0").join(means, "key").select(
        "key", "target", "mean",
        (F.col("target") >= F.col("source_size") * most * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("tilt"), F.lit(-64.0).alias("low"), F.lit(64.0).alias("high"),
        F.lit(False).alias("done")))
    for _ in range(rounds):
        active = state.where("not done and not full and target > 0").select("key", "tilt", "mean")
        if active.isEmpty():
            break
        x = F.col("size") / F.col("mean")
        free = F.col("tilt") * x < F.log(F.lit(float(most)))
        rate = F.when(free, F.exp(F.col("tilt") * x)).otherwise(F.lit(float(most)))
        mass = F.col("n") * F.col("size") * rate
        sums = join_keyed(counts, active, ["key"], "inner").groupBy("key").agg(
            F.sum(mass).alias("got"), F.sum(F.when(free, mass * x).otherwise(0.0)).alias("slope"))
        over = F.col("got") - F.col("target")
        low = F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - over / F.col("slope")
        step = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise(
            (low + high) / 2)
        near = (F.abs(over) <= F.col("target") * tolerance) | (high - low < 1e-14)
        moved = F.col("got").isNotNull()
        state = settled(state.join(sums, "key", "left").select(
            "key", "target", "mean", "full",
            F.when(moved & ~near, step).otherwise(F.col("tilt")).alias("tilt"),
            F.when(moved, low).otherwise(F.col("low")).alias("low"),
            F.when(moved, high).otherwise(F.col("high")).alias("high"),
            (F.col("done") | F.coalesce(near, F.lit(False))).alias("done")))
    return state.select("key", "full", "tilt", "mean")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
        most: float = 2.0, keep: Sequence[str] = ()) -> DataFrame:
    """Copies of each document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``rate``, ``copies``.

    Takes ``doc_id``, ``text``, ``source``; of other columns those of ``keep`` are added, the rest left
    out. ``size`` counts words, 0 for
    a null or empty text, which has rate 0 and no copy. A null source is a source of its own.
    Rates are rounded by position: with documents in order of source, size and id, a document
    gets a copy when the running total of rates passes a whole number, which keeps the words of
    each source within about its largest document of the target. Repeated rows count each.
    An empty table gives an empty one.
    """
    sized = settled(docs.select("doc_id", "source", words(F.col("text")).alias("size"), *keep))
    counts = settled(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = counts.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = settled(source_targets(per_source, weights, share, most)
                      .select(_key(), "source_size", "target"))
    rates = balance(counts.where("size > 0").select(_key(), "size", "n"), targets, most)
    known = targets.join(rates, "key", "left")
    tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.log(F.lit(float(most)))))
    rate = (F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0)
            .when(F.col("full"), F.lit(float(most))).otherwise(tilted))
    rated = join_keyed(sized.withColumn("key", _key()), known, ["key"]).withColumn("rate", rate)
    units = rated.withColumn("_units", F.coalesce(F.round(F.col("rate") * GRID), F.lit(0)).cast("long"))
    units = units.withColumn("_null", F.col("source").isNull())
    placed = running_total(units, ["_null", "source", "size", "doc_id"], "_units", "_before")
    copies = F.floor((F.col("_before") + F.col("_units") + GRID // 2) / F.lit(GRID)) - F.floor(
        (F.col("_before") + GRID // 2) / F.lit(GRID))
    return placed.select("doc_id", "source", "size", "source_size", "target", "rate",
                         copies.cast("long").alias("copies"), *keep)
