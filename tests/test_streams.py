import os
import time
from datetime import datetime, timezone

import pytest

from tests import reference_model as model
from tests.test_files import AS_OF, HOUR, NOW, lines_by_dir, put
from tests.test_rollup import brute
from tideline.functions.telemetry import DEFAULT_KEYS
from tideline.operators import inventory
from tideline.plans import route
from tideline.sources import archive, streams
from tideline.streaming import rollup as live_rollup
from tideline.streaming import shipping, tail

BASE = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)


def ship(spark, tmp_path, as_of, **kw):
    query = shipping.start_shipping(
        spark, str(tmp_path / "spool"), str(tmp_path / "archive"), str(tmp_path / "state"),
        clock=lambda _: as_of, once=True, **kw)
    query.awaitTermination()
    return lines_by_dir(spark, str(tmp_path / "archive"))


def test_held_back_files_ship_later(spark, tmp_path):
    root = str(tmp_path / "spool")
    put(root, "s@main@h", NOW - 3 * HOUR, b"one\n")
    assert ship(spark, tmp_path, AS_OF) == {"s@main@h": ["one"]}
    put(root, "s@main@h", NOW, b"two\n")
    put(root, "s@main@h", NOW - 4 * HOUR, b"late\n")
    held = {"interval_seconds": 5 * 3600, "max_ready_bytes": 1000}
    assert ship(spark, tmp_path, AS_OF, **held) == {"s@main@h": ["one"]}
    late = shipping.late_files(spark, str(tmp_path / "state")).collect()
    assert [(r.label, r.reason) for r in late] == [
        (model.encode(NOW - 4 * HOUR), "behind_watermark")]
    put(root, "other@main@h", NOW, b"x\n")
    later = "2024-01-31 15:00:00"
    assert inventory.clock_ms(later) - (NOW - 3 * HOUR) > 5 * HOUR
    assert ship(spark, tmp_path, later, **held)["s@main@h"] == ["one", "two"]


def test_stream_ships_underscore_directories_and_counts_old_files_as_ready(spark, tmp_path):
    root = str(tmp_path / "spool")
    put(root, "_s@main@h", NOW - 3 * HOUR, b"one\n")
    put(root, "_s@main@h", NOW - 400 * HOUR, b"o" * 2000)
    assert ship(spark, tmp_path, AS_OF) == {"_s@main@h": ["one"]}
    put(root, "_s@main@h", NOW, b"two\n")
    held = {"interval_seconds": 5 * 3600, "max_ready_bytes": 1000}
    assert ship(spark, tmp_path, AS_OF, **held) == {"_s@main@h": ["one", "two"]}


def test_replayed_micro_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "spool")
    put(root, "s@main@h", NOW - HOUR, b"one\n")
    ship(spark, tmp_path, AS_OF)
    commits = tmp_path / "state" / "checkpoint" / "commits"
    for entry in os.listdir(commits):
        if not entry.startswith("."):
            os.remove(commits / entry)
    for entry in os.listdir(commits):
        os.remove(commits / entry)
    assert ship(spark, tmp_path, AS_OF, interval_seconds=0) == {"s@main@h": ["one"]}
    name = shipping.stream_name(spark, str(tmp_path / "state"))
    assert archive.committed_ids(spark, str(tmp_path / "archive")) == [f"{name}-0"]


def test_stream_with_new_state_ships_only_what_is_new(spark, tmp_path):
    root, out = str(tmp_path / "spool"), str(tmp_path / "archive")
    put(root, "s@main@h", NOW - HOUR, b"one\n")
    for state in ("first", "second"):
        shipping.start_shipping(spark, root, out, str(tmp_path / state), clock=lambda _: AS_OF,
                                once=True, interval_seconds=0).awaitTermination()
        put(root, "s@main@h", NOW, b"two\n")
    assert lines_by_dir(spark, out) == {"s@main@h": ["one", "two"]}


def test_replay_on_the_next_day_keeps_its_clock_and_doubles_nothing(spark, tmp_path):
    root, out, state = (str(tmp_path / d) for d in ("spool", "archive", "state"))
    put(root, "s@main@h", NOW - HOUR, b"one\n")
    ship(spark, tmp_path, AS_OF)
    # A crash after the lines were written and before the batch was committed.
    for day in os.listdir(f"{out}/catalogue"):
        for batch in os.listdir(f"{out}/catalogue/{day}"):
            os.remove(f"{out}/catalogue/{day}/{batch}/_SUCCESS")
    for entry in os.listdir(f"{state}/checkpoint/commits"):
        os.remove(f"{state}/checkpoint/commits/{entry}")
    assert ship(spark, tmp_path, "2024-02-01 00:00:05") == {"s@main@h": ["one"]}
    # Lines that such a crash left under another day, without that batch's marker, are not read.
    stray = spark.read.parquet(f"{out}/data").drop("dir_date", "publish_id")
    publish_id = archive.committed_ids(spark, out)[0]
    stray.write.partitionBy("service", "host").parquet(
        f"{out}/data/dir_date=2024-02-01/publish_id={publish_id}")
    assert lines_by_dir(spark, out) == {"s@main@h": ["one"]}


def test_rounds_go_on_without_new_files(spark, tmp_path):
    root = str(tmp_path / "spool")
    put(root, "s@main@h", NOW - HOUR, b"one\n")
    ship(spark, tmp_path, AS_OF)
    seen = []
    query = shipping.start_shipping(
        spark, root, str(tmp_path / "archive2"), str(tmp_path / "state2"),
        clock=lambda b: seen.append(b) or AS_OF, round_seconds=1)
    try:
        until = time.time() + 60
        while len(seen) < 3 and time.time() < until and query.isActive:
            time.sleep(0.5)
    finally:
        query.stop()
    assert len(seen) >= 3
    assert lines_by_dir(spark, str(tmp_path / "archive2")) == {"s@main@h": ["one"]}


@pytest.mark.parametrize("cap", [5, 1000])
def test_rollup_stream_equals_the_buffer(spark, tmp_path, cap):
    source, state, out = (str(tmp_path / d) for d in ("in", "state", "out"))
    os.makedirs(source)
    rows = [(w * 30_000 + i * 7, w * 100 + i, ["files_to_ship", "x"][i % 2], i)
            for w, n in enumerate([3, 12, 0, 1, 8, 2]) for i in range(n)]
    cut = len(rows) // 2
    for part, chunk in enumerate((rows[:cut], rows[cut:])):
        with open(f"{source}/p{part}.txt", "w") as f:
            for ms, _, key, n in chunk:
                f.write(f"{BASE + ms} svc main {key} {n}\n")
            f.write("nonsense\n" if part else f"{BASE} svc main x many\n")
            if part:
                f.write(f"{BASE + 1} svc main x 1\n")
        live_rollup.start_rollup(streams.telemetry(spark, source), state, out, once=True,
                                 delay_seconds=0, cap=cap).awaitTermination()
    live_rollup.finish_rollup(spark, state, out, cap=cap)
    got = {((r.window_ms - BASE) // 30_000, r.key): r.total
           for r in live_rollup.emitted(spark, out).collect()}
    want = brute(rows, cap)
    want.update({(2, key): 0 for key in DEFAULT_KEYS})
    assert got == want
    assert spark.read.parquet(f"{state}/late").count() == 1
    assert spark.read.parquet(f"{state}/quarantine").count() == 2


def test_a_clock_that_runs_ahead_closes_no_window(spark, tmp_path):
    source, state, out = (str(tmp_path / d) for d in ("in", "state", "out"))
    os.makedirs(source)
    for part, stamps in enumerate(([0, 1, 90 * 86_400_000], [30_000, 90_000])):
        with open(f"{source}/{part}.txt", "w") as f:
            f.writelines(f"{BASE + ms} svc main x 1\n" for ms in stamps)
        live_rollup.start_rollup(
            streams.telemetry(spark, source), state, out, once=True, delay_seconds=0,
            clock=lambda _: "2024-01-01 00:02:00").awaitTermination()
    live_rollup.finish_rollup(spark, state, out)
    got = {(r.window_ms - BASE, r.total) for r in live_rollup.emitted(spark, out).where("key = 'x'").collect()}
    assert got == {(0, 2), (30_000, 1), (90_000, 1)}
    assert [r.fault for r in spark.read.parquet(f"{state}/quarantine").collect()] == ["future_time"]


def test_plain_windowed_sums(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(source)
    for i, ms in enumerate((0, 31_000, 200_000)):
        with open(f"{source}/{i}.txt", "w") as f:
            f.write(f"{BASE + ms} svc main x 2\n{BASE + ms} svc main x 3\n")
        stream = live_rollup.windowed_sums(streams.telemetry(spark, source), "10 seconds")
        tail.start_tail(stream, out, str(tmp_path / "cp"), once=True).awaitTermination()
    got = {(r.window_ms - BASE, r.key): r.total for r in spark.read.parquet(out).collect()}
    assert got == {(0, "x"): 5, (30_000, "x"): 5}


def test_live_tail_of_two_publishers(spark, tmp_path):
    for host in ("h1", "h2"):
        for topic in (f"svc.main.{host}", f"svc.errors.{host}"):
            folder = tmp_path / host / topic
            folder.mkdir(parents=True)
            (folder / "0.txt").write_text(f"{topic} a\n\n{topic} b\n")
    publishers = [str(tmp_path / h) for h in ("h1", "h2")]
    lines = tail.live_tail(spark, publishers, ["svc.errors", "svc.main.h2"])
    out = str(tmp_path / "out")
    tail.start_tail(lines, out, str(tmp_path / "cp"), once=True).awaitTermination()
    got = sorted(r.line for r in spark.read.parquet(out).collect())
    assert got == sorted(f"{t} {x}" for t in ("svc.errors.h1", "svc.errors.h2", "svc.main.h2")
                         for x in "ab")


def test_prefix_table_equals_prefix_filter(spark):
    rows = [(f"s{i % 7}.{s}.h{i % 3}", f"line {i}") for i in range(300) for s in ("main", "errors")]
    rows += [("hot.main.h1", f"hot {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "topic string, line string")
    prefixes = ["s1", "s1.main", "s2.errors.h2", "hot", "none", "s3.main.h1.and.more"]
    table = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    want = sorted(map(tuple, route.tail(df, prefixes).collect()))
    assert sorted(map(tuple, route.tail_subscriptions(df, table).collect())) == want
    everything = spark.createDataFrame([("",)], "prefix string")
    assert route.tail_subscriptions(df, everything).count() == len(rows)
