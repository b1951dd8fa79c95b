import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

from tideline.functions.telemetry import DEFAULT_KEYS
from tideline.operators import rollup

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)


def records(spark, rows):
    return spark.createDataFrame(
        [(BASE + timedelta(milliseconds=ms), seq, key, n) for ms, seq, key, n in rows],
        "ts timestamp, seq bigint, key string, amount int")


def brute(rows, cap):
    """A buffer per window: four zeros first, then the records, the newest ``cap`` kept."""
    windows = defaultdict(list)
    for ms, seq, key, n in sorted(rows):
        windows[ms // 30_000].append((key, n))
    out = {}
    for w, items in windows.items():
        buffer = ([(k, 0) for k in DEFAULT_KEYS] + items)[-cap:]
        sums = Counter()
        for key, n in buffer:
            sums[key] += n
        for key, n in sums.items():
            out[(w, key)] = n
    return out


def as_dict(df):
    lo = int(BASE.timestamp() * 1000)
    return {((r.window_ms - lo) // 30_000, r.key): r.total for r in df.collect()}


def test_cap_and_zero_fill_match_the_buffer(spark):
    rng = random.Random(4)
    rows = []
    # One crowded window, one around each cap edge, some quiet ones.
    for w, n in enumerate([700, 20, 19, 18, 17, 16, 15, 3, 1]):
        for _ in range(n):
            rows.append((w * 30_000 + rng.randrange(30_000), len(rows),
                         rng.choice(["files_to_ship", "x", "y"]), rng.randint(-3, 9)))
    got = as_dict(rollup.rollup(records(spark, rows), cap=20))
    assert got == brute(rows, 20)
    assert as_dict(rollup.rollup(records(spark, rows), cap=None)) == brute(rows, 10**6)


def test_newest_records_by_time_then_sequence(spark):
    rows = [(1000, i, "k", 1) for i in range(50)] + [(2000, 100, "k", 1)]
    df = rollup.newest_records(records(spark, rows).withColumnRenamed("key", "g"), ["g"], cap=3)
    assert sorted(r.seq for r in df.collect()) == [48, 49, 100]


def test_group_limit_reaches_the_map_side(spark):
    df = rollup.newest_records(records(spark, [(1, 1, "k", 1)]), ["key"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_empty_windows_between_get_zeros(spark):
    rows = [(0, 0, "x", 1), (95_000, 1, "x", 1)]
    full = as_dict(rollup.fill_empty_windows(rollup.rollup(records(spark, rows))))
    assert {w for w, _ in full} == {0, 1, 2, 3}
    assert {k for w, k in full if w == 1} == set(DEFAULT_KEYS)
    assert full[(2, "lost_during_ship")] == 0


def test_by_columns(spark):
    df = records(spark, [(0, 0, "x", 1), (1, 1, "x", 2)]).withColumn("host", rollup.F.col("seq"))
    got = {(r.host, r.key): r.total for r in rollup.rollup(df, by=["host"]).collect()}
    assert got[(0, "x")] == 1 and got[(1, "x")] == 2
    assert len(got) == 2 + 2 * len(DEFAULT_KEYS)


def test_no_cap_unless_asked_for(spark):
    rows = [(i % 29_000, i, "x", 1) for i in range(3_000)]
    df = records(spark, rows)
    assert as_dict(rollup.rollup(df))[(0, "x")] == 3_000
    assert [r.n_dropped for r in rollup.dropped_records(df, ()).collect()] == [2_000]
    assert rollup.dropped_records(df, (), cap=3_000).isEmpty()
