import random
from datetime import datetime, timedelta, timezone

from tideline.operators import errors
from tideline.plans import runlog

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_phase_timers(spark):
    rows = [("combine", n) for n in range(1, 101)] + [("ship", 7)]
    got = {r.phase: r for r in runlog.phase_timers(
        spark.createDataFrame(rows, "phase string, duration_ms bigint")).collect()}
    c = got["combine"]
    assert (c.n_runs, c.min_ms, c.max_ms, c.total_ms) == (100, 1, 100, 5050)
    assert (c.p50_ms, c.p95_ms) == (50, 95)
    assert got["ship"].p95_ms == 7


def test_percentiles_are_exact_beyond_any_sketch(spark):
    rng = random.Random(5)
    runs = [("combine", rng.randrange(-9_000, 3_000_000)) for _ in range(60_000)]
    runs += [("skewed", rng.choice([4095, 4096, 4097])) for _ in range(1_000)] + [(None, 3), ("none", None)]
    got = {r.phase: r for r in runlog.phase_timers(
        spark.createDataFrame(runs, "phase string, duration_ms bigint")).collect()}
    for phase in ("combine", "skewed", None):
        values = sorted(n for p, n in runs if p == phase)
        at = [values[-(-len(values) * p // 100) - 1] for p in (50, 95)]
        assert [got[phase].p50_ms, got[phase].p95_ms] == at
        assert (got[phase].n_runs, got[phase].total_ms) == (len(values), sum(values))
    assert (got["none"].n_runs, got["none"].p50_ms, got["none"].total_ms) == (1, None, None)


def test_only_fatal_errors_are_metered(spark):
    rows = [(T0 + timedelta(seconds=s), fatal) for s, fatal in
            [(0, True), (59, True), (60, True), (61, False)]]
    got = runlog.fatal_errors(spark.createDataFrame(rows, "ts timestamp, is_fatal boolean"))
    assert sorted(r.n_fatal for r in got.collect()) == [1, 2]


def test_in_flight(spark):
    rows = [("ship", True, True), ("ship", True, False), ("ship", True, False)]
    df = spark.createDataFrame(rows, "phase string, started boolean, ended boolean")
    assert runlog.in_flight(df).first().in_flight == 2


def test_observed_counts_without_a_second_pass(spark):
    df, seen = runlog.observed(spark.range(1234), "rows-seen")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 1234


def test_collapse_gives_values_or_errors(spark):
    rows = [("d1", "a", True), ("d1", "b", True), ("d2", "c", True), ("d2", "x", False)]
    df = spark.createDataFrame(rows, "d string, n string, name_ok boolean")
    assert sorted(r.n for r in errors.collapse(df, ["d"]).collect()) == ["a", "b", "x"]
