"""The kept inventory of a spool, problems of rounds and retention between them."""

import os
import random
import shutil
import time

import pytest

from tests.test_files import AS_OF, HOUR, NOW, lines_by_dir, put, touch
from tideline.operators.inventory import DIR_KEYS
from tideline.plans import problems, rounds, runlog
from tideline.session import ensure_checkpoint_dir, matching_paths
from tideline.sources import archive, files, index, walk
from tideline.streaming import shipping


def settle_clock(root):
    """Directories that last changed long ago, so that the margin of the clock does not matter."""
    for name in os.listdir(root):
        at = time.time_ns() - 60 * 10 ** 9 + random.randrange(10 ** 9)
        os.utime(os.path.join(root, name), ns=(at, at))


def held(known):
    return sorted((r.dir_name, r.file_name, r.size_bytes) for r in known.files().collect())


def on_disk(root):
    return sorted((d, f, os.path.getsize(os.path.join(root, d, f)))
                  for d in os.listdir(root) if os.path.isdir(os.path.join(root, d))
                  for f in os.listdir(os.path.join(root, d))
                  if not f.startswith(".") and os.path.isfile(os.path.join(root, d, f)))


def test_a_walk_finds_empty_files_and_directories_and_nothing_else(spark, tmp_path):
    root = str(tmp_path)
    rng = random.Random(3)
    for name in ("s@main@h", "_t@main@h", ".u@x@y", "a=b@c@d", "sp ace@%41+@h", "plain"):
        os.makedirs(os.path.join(root, name, "deeper"))
        touch(root, name, "deeper", "hidden from the walk")
        for i in range(rng.randrange(4)):
            with open(os.path.join(root, name, f"f{i}"), "wb") as out:
                out.write(b"x" * rng.randrange(3))
    touch(root, "a file beside the directories")
    os.makedirs(os.path.join(root, "empty@main@h"))
    dirs = walk.directories(spark, root)
    assert sorted(r.dir_name for r in dirs.collect()) == sorted(d for d in os.listdir(root) if "file" not in d)
    found = files.rotated_files(spark, root).collect()
    assert sorted((r.dir_name, r.file_name, r.size_bytes) for r in found) == on_disk(root)
    assert all(os.path.exists(r.path.removeprefix("file:")) for r in found)
    gone = spark.createDataFrame([("g", "file:/no/such"), ("f", f"file:{root}/plain/deeper/hidden from the walk")],
                                 "dir_name string, path string")
    assert [(r.dir_name, r.error.split(":")[0]) for r in walk.entries(gone).collect()] == [("f", "NotADirectoryError")]
    assert {(r.dir_name, r.dir_ok) for r in files.service_dirs(spark, root).where("dir_name like 'e%' or dir_name = 'plain'").collect()} == {
        ("empty@main@h", True), ("plain", False)}


@pytest.mark.parametrize("compact_after", [1, 100])
def test_only_changed_directories_are_listed_and_nothing_stays_that_has_gone(spark, tmp_path, compact_after):
    root, kept = str(tmp_path / "spool"), str(tmp_path / "index")
    for d in ("a@main@h", "b@main@h", "c@main@h"):
        for i in range(3):
            put(root, d, NOW - i * HOUR, b"x" * i)
    os.makedirs(os.path.join(root, "idle@main@h"))
    touch(root, "a@main@h", "no label")
    settle_clock(root)
    step = lambda n: index.advance(spark, root, kept, n, compact_after=compact_after)
    known = step(0)
    assert known.listed == 4 and held(known) == on_disk(root) and known.fresh.count() == 10
    assert {(r.service, r.n_files, r.ready_bytes) for r in known.state().collect()} == {(s, 3, 3) for s in "abc"}
    put(root, "b@main@h", NOW + HOUR, b"new")
    known = step(1)
    assert known.listed == 1 and held(known) == on_disk(root)
    assert [r.dir_name for r in known.fresh.collect()] == ["b@main@h"]
    settle_clock(root)  # changes every directory's time
    known = step(2)
    assert known.listed == 4 and known.fresh.count() == 0
    os.remove(os.path.join(root, "c@main@h", os.listdir(os.path.join(root, "c@main@h"))[0]))
    shutil.rmtree(os.path.join(root, "b@main@h"))
    known = step(3)
    assert known.listed == 1 and held(known) == on_disk(root) and known.fresh.count() == 0
    assert {r.service: r.n_files for r in known.state().collect()} == {"a": 3, "c": 2}
    put(root, "a@main@h", NOW + HOUR, b"replayed")
    assert held(step(3)) == on_disk(root)  # a replay sees the spool as it is then
    for n in range(4, 6):
        put(root, "c@main@h", NOW + n * HOUR, b"more")
        known = step(n)
        assert held(known) == on_disk(root)
    only = known.dirs.where("dir_name like 'c@%'").select("dir_name")
    assert {r.dir_name for r in known.files(only).collect()} == {"c@main@h"}
    assert len(matching_paths(spark, f"{kept}/dirs/*")) == 2
    assert len(matching_paths(spark, f"{kept}/files/*")) <= 4


def test_a_directory_that_just_changed_is_listed_again(spark, tmp_path):
    root, kept = str(tmp_path / "spool"), str(tmp_path / "index")
    put(root, "a@main@h", NOW, b"x")
    assert [index.advance(spark, root, kept, n).listed for n in (0, 1)] == [1, 1]
    assert index.advance(spark, root, kept, 2, margin_us=-10 ** 12).listed == 0


def test_an_empty_spool_is_no_error(spark, tmp_path):
    root = tmp_path / "spool"
    root.mkdir()
    done = rounds.run_round(spark, str(root), str(tmp_path / "archive"), AS_OF, "r1")
    assert not done.published and done.plan.count() == 0


def ship(spark, tmp_path, as_of, **kw):
    shipping.start_shipping(
        spark, str(tmp_path / "spool"), str(tmp_path / "archive"), str(tmp_path / "state"),
        clock=lambda _: as_of, once=True, **kw).awaitTermination()


def test_rounds_remove_what_retention_names_after_a_shipment_and_after_none(spark, tmp_path):
    root = str(tmp_path / "spool")
    for hours in (1, 2, 3, 24 * 5, 24 * 6):
        put(root, "s@main@h", NOW - hours * HOUR, b"x" * 100 + b"\n")
    put(root, "big@main@h", NOW - 2 * HOUR, b"y" * 100 + b"\n")
    put(root, "big@main@h", NOW - HOUR, b"y" * 5000 + b"\n")
    touch(root, "bad@name", "x")
    scratch = set(os.listdir(ensure_checkpoint_dir(spark)))
    # Shipped: files before the last shipped one go, as far as 250 bytes of the directory stay.
    ship(spark, tmp_path, AS_OF, delete=True, min_bytes=250)
    assert set(os.listdir(ensure_checkpoint_dir(spark))) == scratch  # a round leaves no table behind
    state = str(tmp_path / "state")
    removed = lambda n: spark.read.parquet(f"{state}/removed/batch_id={n}")
    assert removed(0).count() == 4  # 505 bytes in s: the file of 303 bytes left goes, of 202 stays
    assert {d: len(os.listdir(os.path.join(root, d))) for d in os.listdir(root)} == {
        "s@main@h": 2, "big@main@h": 1, "bad@name": 1}
    # Throttled: only what is older than a day more than the look-back.
    put(root, "s@main@h", NOW - 24 * 7 * HOUR, b"z" * 1000)
    put(root, "s@main@h", NOW - 24 * 2 * HOUR, b"z" * 1000)
    ship(spark, tmp_path, AS_OF, delete=True, min_bytes=250)
    assert [r.label for r in removed(1).collect()] == [
        min(r.label for r in shipping.late_files(spark, state).collect())]
    assert len(os.listdir(os.path.join(root, "s@main@h"))) == 3
    # The index of the stream follows its own deletes.
    ship(spark, tmp_path, AS_OF, delete=True, min_bytes=250)
    last = max(matching_paths(spark, f"{state}/index/dirs/*"), key=lambda p: int(p.rsplit("=", 1)[1]))
    kept = index.Index(spark, f"{state}/index", spark.read.schema(index.DIRS_SCHEMA).parquet(last), None, 0)
    assert held(kept) == on_disk(root)


def test_replay_after_a_shipment_keeps_the_same_limit_for_retention(spark, tmp_path):
    root = str(tmp_path / "spool")
    for hours in (1, 2, 3):
        put(root, "s@main@h", NOW - hours * HOUR, b"x" * 100)
    ship(spark, tmp_path, AS_OF)
    commits = tmp_path / "state" / "checkpoint" / "commits"
    for entry in os.listdir(commits):
        os.remove(commits / entry)
    ship(spark, tmp_path, AS_OF, delete=True, min_bytes=0)  # published before, not yet cleaned
    assert len(os.listdir(os.path.join(root, "s@main@h"))) == 1


def test_each_stage_of_a_round_leaves_its_problems(spark, tmp_path):
    root, out, state = (str(tmp_path / d) for d in ("spool", "archive", "state"))
    put(root, "s@main@h", NOW - HOUR, b"one\n")
    put(root, "future@main@h", NOW + HOUR, b"one\n")
    touch(root, "s@main@h", "current")
    touch(root, "bad@name", "x")
    os.makedirs(os.path.join(root, "also bad"))
    ship(spark, tmp_path, AS_OF)
    assert lines_by_dir(spark, out) == {"s@main@h": ["one"], "future@main@h": ["one"]}
    stray = spark.createDataFrame([("no archive name", "s", "main", "h", 1, 1, "@")], ", ".join(
        f"{c} {t}" for c, t in zip(["file_name", *DIR_KEYS, "n_files", "bytes", "last_label"], ["string"] * 4 + ["bigint"] * 2 + ["string"])))
    stray.write.parquet(f"{out}/catalogue/dir_date={AS_OF[:10]}/publish_id=stray")
    spark.createDataFrame([], archive.LEDGER_SCHEMA).drop("publish_id", "dir_date").write.parquet(
        f"{out}/ledger/dir_date={AS_OF[:10]}/publish_id=stray")
    ship(spark, tmp_path, AS_OF)
    rows = problems.recorded(spark, out).where("round_id like '%-1'")
    got = {(r.service, r.dir_name, r.file_name, r.error_kind, r.is_fatal) for r in rows.collect()}
    assert got == {
        ("s", "s@main@h", "current", "invalid_name", True),
        (None, "bad@name", None, "bad_directory", True),
        (None, "also bad", None, "bad_directory", True),
        (None, "2024/01-31", "no archive name", "invalid_archive_name", True),
        ("s", None, None, "nothing_to_sync", False),
        ("future", None, None, "future_label", True),
    }
    report = {(r.service, r.error_kind): (r.n_errors, r.n_directories) for r in problems.report(rows).collect()}
    assert report[None, "bad_directory"] == (2, 2) and report["s", "invalid_name"] == (1, 1)
    fatal = runlog.fatal_errors(rows.withColumnRenamed("at", "ts")).collect()
    assert [r.n_fatal for r in fatal] == [5]
    log = shipping.run_log(spark, state)
    assert {r.phase: r.n_runs for r in runlog.phase_timers(log).collect()} == {
        "round": 2, "list": 2, "plan": 2, "ship": 1}
    assert {r.in_flight for r in runlog.in_flight(log).collect()} == {0}
    with pytest.raises(Exception, match="bad archive name"):
        rounds.run_round(spark, root, out, "2024-01-31 20:00:00", "strict", strict=True)


def test_excluded_names_reach_a_round(spark, tmp_path):
    root, out = str(tmp_path / "spool"), str(tmp_path / "archive")
    put(root, "s@main@h", NOW - HOUR, b"one\n")
    put(root, "s@main@h", NOW - 2 * HOUR, b"two\n", suffix=".skip")
    rounds.run_round(spark, root, out, AS_OF, "r1", exclude=(r".*\.skip",))
    assert lines_by_dir(spark, out) == {"s@main@h": ["one"]}
    assert archive.ledger(spark, out).count() == 1
