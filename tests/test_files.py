import gzip
import io
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests import reference_model as model
from tideline.operators import inventory, retention
from tideline.operators.inventory import DIR_KEYS
from tideline.plans import compact, problems, rounds, ship
from tideline.sources import archive, files, reading

AS_OF = "2024-01-31 12:00:00"
NOW = inventory.clock_ms(AS_OF)
HOUR = 3_600_000


def put(root, directory, ms, body, suffix=".s"):
    folder = os.path.join(root, directory)
    os.makedirs(folder, exist_ok=True)
    name = f"@{model.encode(ms)}{suffix}"
    with open(os.path.join(folder, name), "wb") as out:
        out.write(body)
    return name


def touch(root, *parts):
    path = os.path.join(root, *parts)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(b"x")


def in_order(lines):
    return [r.line for r in lines.orderBy("archive_name", "label", "block", "pos").collect()]


def test_inventory_of_a_spool(spark, tmp_path):
    root = str(tmp_path)
    name = put(root, "svc@main@h1", NOW, b"12345")
    touch(root, "svc@main@h1", ".hidden")
    touch(root, "svc@main@h1", "current")
    touch(root, "not-a-service", "x")
    found = files.rotated_files(spark, root)
    good = found.where("dir_ok").select("service", "host", "file_name", "size_bytes").collect()
    assert sorted(map(tuple, good)) == [("svc", "h1", name, 5), ("svc", "h1", "current", 1)]
    assert found.where("NOT dir_ok").count() == 1
    dirs = files.service_dirs(spark, root)
    assert {(r.dir_name, r.dir_ok) for r in dirs.collect()} == {
        ("svc@main@h1", True), ("not-a-service", False)}
    plan = found.select("file_name")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_directories_with_a_leading_underscore_are_listed_and_shipped(spark, tmp_path):
    root = str(tmp_path / "spool")
    for folder in ("_svc@main@h1", ".svc@main@h1", "_{a}@main@h1", "_a=b@main@h1", "svc@main@h1"):
        put(root, folder, NOW - HOUR, f"{folder}\n".encode())
    touch(root, "_bad", "x")
    found = files.rotated_files(spark, root)
    assert sorted((r.dir_name, r.dir_ok) for r in found.collect()) == sorted(
        [(d, d != "_bad") for d in os.listdir(root)])
    assert sorted(r.line for r in files.log_lines(spark, root).collect()) == sorted(set(os.listdir(root)) - {"_bad"})
    out = str(tmp_path / "archive")
    rounds.run_round(spark, root, out, AS_OF, "r1")
    want = {d: [d] for d in os.listdir(root) if d != "_bad"}
    assert lines_by_dir(spark, out) == want


def test_archive_listing_of_the_look_back(spark, tmp_path):
    root = str(tmp_path)
    for day in ("2024/01-31", "2024/01-29", "2024/01-20"):
        touch(root, *day.split("/"), f"{day[-2:]}.seq")
    os.makedirs(os.path.join(root, "tmp"))
    days = files.lookback_days(AS_OF, 3)
    got = {str(r.dir_date): r.file_name for r in files.archive_files(spark, root, days).collect()}
    assert got == {"2024-01-31": "31.seq", "2024-01-29": "29.seq"}
    assert files.archive_files(spark, root).count() == 3
    assert files.archive_files(spark, str(tmp_path / "absent"), days).count() == 0


def test_lines_break_as_text_readers_do_and_never_join_files(spark, tmp_path):
    root = str(tmp_path)
    bodies = [b"a\nb", b"c\r\nd\re\n", b"", b"\n\nf\n", b"x\xffy", "grün\n".encode()]
    for i, body in enumerate(bodies):
        put(root, "svc@main@h 1+2", NOW + i, body)
    lines = files.log_lines(spark, root)
    rows = lines.orderBy("file_name", "block", "pos").select(
        "host", F.col("line").cast("binary").alias("line")).collect()
    assert [bytes(r.line) for r in rows] == [
        b"a", b"b", b"c", b"d", b"e", b"", b"", b"f", b"x\xffy", "grün".encode()]
    assert {r.host for r in rows} == {"h 1+2"}


def test_big_files_are_split_and_keep_their_line_order(spark, tmp_path):
    root = str(tmp_path)
    put(root, "svc@main@h1", NOW, b"".join(b"line %07d\n" % i for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 65_536)
    try:
        lines = files.log_lines(spark, root)
        assert lines.rdd.getNumPartitions() > 4
        got = [r.line for r in lines.orderBy("block", "pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"line {i:07d}" for i in range(50_000)]


def test_files_below_the_bound_are_not_read(spark, tmp_path):
    root = str(tmp_path)
    put(root, "svc@main@h1", NOW - HOUR, b"old\n")
    new = put(root, "svc@main@h1", NOW, b"new\n")
    lines = files.log_lines(spark, root, from_name=new)
    assert [r.line for r in lines.collect()] == ["new"]
    scanned = lines.rdd.getNumPartitions()
    assert scanned == 1


def spool(root, seed, hot_files=60):
    """One hot directory and a few small ones; returns the expected lines per directory."""
    rng = random.Random(seed)
    want = {}
    for directory, n in [("hot@main@h1", hot_files), ("a@main@h1", 3), ("a@err@h1", 2),
                         ("b@main@h2", 1)]:
        times = sorted(rng.sample(range(NOW - 20 * HOUR, NOW - HOUR), n))
        for ms in times:
            body = [f"{directory} {ms} {i} " + "x" * rng.randint(0, 30) for i in range(20)]
            put(root, directory, ms, "\n".join(body).encode() + b"\n")
            want.setdefault(directory, []).extend(body)
    return want


def lines_by_dir(spark, root):
    got = {}
    for r in archive.archived_lines(spark, root).orderBy("label", "block", "pos").collect():
        got.setdefault(f"{r.service}@{r.category}@{r.host}", []).append(r.line)
    return got


@pytest.mark.parametrize("shard_bytes", [1 << 29, 3000, 200])
def test_round_merges_publishes_and_is_idempotent(spark, tmp_path, shard_bytes):
    root, out = str(tmp_path / "spool"), str(tmp_path / "archive")
    want = spool(root, shard_bytes)
    done = rounds.run_round(spark, root, out, AS_OF, "r1", shard_bytes=shard_bytes)
    assert done.published
    assert lines_by_dir(spark, out) == want
    listing = archive.catalogue(spark, out, files.lookback_days(AS_OF, 3)).collect()
    assert len(listing) == 4
    assert {str(r.dir_date) for r in listing} == {"2024-01-31"}
    lines = archive.archived_lines(spark, out)
    shards = lines.where("service = 'hot'").select("shard").distinct().count()
    assert (shards > 5) == (shard_bytes < 10_000)
    # Ordered inside every written file, without sorting again.
    in_file = lines.withColumn("file", F.input_file_name()).withColumn(
        "at", F.monotonically_increasing_id())
    by = Window.partitionBy("file", "service", "category", "shard").orderBy("label", "block", "pos")
    assert in_file.withColumn("bad", F.col("at") < F.lag("at").over(by)).where("bad").count() == 0
    # The same round again, and a new round over the same files: nothing changes.
    assert not rounds.run_round(spark, root, out, AS_OF, "r1", shard_bytes=shard_bytes).published
    assert not rounds.run_round(spark, root, out, AS_OF, "r2", interval_seconds=0).published
    assert lines_by_dir(spark, out) == want


def test_next_round_ships_only_what_is_new(spark, tmp_path):
    root, out = str(tmp_path / "spool"), str(tmp_path / "archive")
    want = spool(root, 5, hot_files=3)
    rounds.run_round(spark, root, out, AS_OF, "r1")
    put(root, "a@main@h1", NOW, b"fresh\n")
    put(root, "a@main@h1", NOW - 30 * HOUR, b"too late\n")
    done = rounds.run_round(spark, root, out, AS_OF, "r2")
    assert {r.category: r.decision for r in done.plan.where("service = 'a'").collect()} == {
        "main": "interval", "err": "interval"}
    want["a@main@h1"].append("fresh")
    assert lines_by_dir(spark, out) == want
    assert archive.committed_ids(spark, out) == ["r1", "r2"]
    marks = {r.service: r.ledger_label for r in archive.ledger_marks(spark, out).collect()}
    assert marks["a"] == model.encode(NOW)


@pytest.mark.parametrize("parity", [False, True])
def test_silent_service_ships_twice_only_in_parity(spark, tmp_path, parity):
    root, out = str(tmp_path / "spool"), str(tmp_path / "archive")
    put(root, "s@main@h", NOW - 10 * HOUR, b"one\n")
    rounds.run_round(spark, root, out, AS_OF, "r1")
    later = "2024-02-04 23:00:00"
    put(root, "s@main@h", inventory.clock_ms(later), b"two\n")
    done = rounds.run_round(spark, root, out, later, "r2", parity=parity)
    assert done.plan.first().decision == "first"
    assert done.outstanding.count() == (2 if parity else 1)
    assert sorted(lines_by_dir(spark, out)["s@main@h"]) == (
        ["one", "one", "two"] if parity else ["one", "two"])


def test_unfinished_batch_is_invisible_and_can_be_redone(spark, tmp_path):
    root, out = str(tmp_path / "spool"), str(tmp_path / "archive")
    want = spool(root, 8, hot_files=2)
    rounds.run_round(spark, root, out, AS_OF, "r1")
    os.remove(os.path.join(out, "catalogue", "dir_date=2024-01-31", "publish_id=r1", "_SUCCESS"))
    assert archive.archived_lines(spark, out).count() == 0
    assert archive.catalogue(spark, out).count() == 0
    assert rounds.run_round(spark, root, out, AS_OF, "r1").published
    assert lines_by_dir(spark, out) == want


def test_retention_deletes_what_the_manifest_names(spark, tmp_path):
    root, out = str(tmp_path / "spool"), str(tmp_path / "archive")
    spool(root, 3, hot_files=5)
    done = rounds.run_round(spark, root, out, AS_OF, "r1")
    flagged = rounds.retention_after(spark, root, done, AS_OF, min_bytes=0)
    doomed = {r.path for r in flagged.where("to_delete").collect()}
    assert len(doomed) == 4 + 2 + 1
    row = retention.summary(flagged.where("service = 'hot'")).first()
    assert row.n_deleted == 4
    archive.delete_files(flagged)
    archive.delete_files(spark.createDataFrame([(p, True) for p in doomed],
                                               "path string, to_delete boolean"))
    left = files.rotated_files(spark, root)
    assert left.count() == 4
    assert {r.path for r in left.collect()}.isdisjoint(doomed)


@pytest.mark.parametrize("codec", [archive.SNAPPY, archive.DEFLATE])
def test_sequence_file_round_trip(spark, tmp_path, codec):
    path = str(tmp_path / "seq")
    df = spark.createDataFrame([(NOW, "grün"), (NOW, ""), (NOW, "a b")], "ship_ms bigint, line string")
    archive.write_sequence_file(df.coalesce(1), path, codec)
    assert [tuple(r) for r in archive.read_sequence_file(spark, path).collect()] == [
        (NOW, "grün"), (NOW, ""), (NOW, "a b")]
    raw = b"".join(open(os.path.join(path, f), "rb").read() for f in os.listdir(path)
                   if f.startswith("part"))
    assert codec.encode() in raw and b"LongWritable" in raw and b"BytesWritable" in raw


def test_shard_width_follows_the_biggest_shard(spark):
    rows = [("s", "main", h, f"@{model.encode(NOW - i * gap)}.s", 100)
            for h, gap in (("dense", 1), ("spread", 5_000_000)) for i in range(20)]
    found = inventory.usable(spark.createDataFrame(
        rows, "service string, category string, host string, file_name string, size_bytes bigint"))
    width = {}
    for size in (2000, 300, 50):
        for r in compact.batches(found, size).collect():
            width[(r.host, size)] = r.shard_width
    assert width == {("dense", 2000): 0, ("dense", 300): 24, ("dense", 50): 24,
                     ("spread", 2000): 0, ("spread", 300): 13, ("spread", 50): 24}
    assert DIR_KEYS == ["service", "category", "host"]
    assert ship.MAX_READY_BYTES == 1024**3


def test_bad_directories_are_quarantined_and_idle_folders_not_read(spark, tmp_path):
    root, out = str(tmp_path / "spool"), str(tmp_path / "archive")
    put(root, "s@main@h", NOW - HOUR, b"one\n")
    put(root, "bad@name", NOW - HOUR, b"lost\n")
    done = rounds.run_round(spark, root, out, AS_OF, "r1")
    assert rounds.shipping_folders(root, done.units) == [f"{root}/s@main@h"]
    bad = problems.recorded(spark, out).where("is_fatal").collect()
    assert [(r.dir_name, r.error_kind) for r in bad] == [("bad@name", "bad_directory")]


def test_many_small_files_are_read_by_few_tasks_and_not_listed_by_the_driver(spark, tmp_path):
    root = str(tmp_path)
    for i in range(120):
        put(root, f"s@main@h{i % 3}", NOW + i, b"%d a\n%d b" % (i, i))
    lines = files.log_lines(spark, root)
    assert lines.rdd.getNumPartitions() <= 4
    # The scans are of the ranges, a table of our own: no file of the spool is an input of the plan.
    assert not [f for f in lines.inputFiles() if "@main@" in f]
    assert sorted(r.line for r in lines.collect()) == sorted(f"{i} {x}" for i in range(120) for x in "ab")


def test_a_line_is_in_one_range_wherever_the_cuts_lie(monkeypatch):
    rng = random.Random(7)
    for _ in range(2000):
        data = rng.choice([b"", reading.BOM]) + bytes(rng.choice(b"a\r\nb\xef") for _ in range(rng.randint(0, 25)))
        step = rng.randint(1, 9)
        monkeypatch.setattr(reading, "BLOCK", rng.randint(3, 6))
        got = []
        for start in range(0, max(len(data), 1), step):
            source = io.BytesIO(data)
            source.seek(start)
            for found in reading.lines_from(source, start, start + step if start + step < len(data) else None):
                got += found
        assert got == data.removeprefix(reading.BOM).splitlines()


def test_packed_and_grown_files_are_read_whole_and_gone_ones_left_out(spark, tmp_path):
    folder = tmp_path / "s@main@h"
    folder.mkdir()
    (folder / "a.gz").write_bytes(gzip.compress(b"one\ntwo\n" * 50))
    (folder / "grown").write_bytes(b"three\nfour\n")
    rows = [("s", "main", "h", name, f"file:{folder}/{name}", 3) for name in ("a.gz", "grown", "gone")]
    found = spark.createDataFrame(
        rows, "service string, category string, host string, file_name string, path string, size_bytes bigint")
    got = [r.line for r in files.lines_of(found).orderBy("file_name", "block", "pos").collect()]
    assert got == ["one", "two"] * 50 + ["three", "four"]


def test_deletions_are_dealt_over_the_tasks(spark, tmp_path):
    made = [put(str(tmp_path), "s@main@h", NOW + i, b"x") for i in range(20)]
    rows = [(f"file:{tmp_path}/s@main@h/{name}", i > 0) for i, name in enumerate(made)]
    flagged = spark.createDataFrame(rows, "path string, to_delete boolean").coalesce(1)
    spark.sparkContext.setJobGroup("deletions", "")
    archive.delete_files(flagged)
    spark.sparkContext.setJobGroup("", "")
    assert os.listdir(tmp_path / "s@main@h") == made[:1]
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("deletions") for s in tracker.getJobInfo(job).stageIds]
    assert max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) >= 4


def test_names_out_of_an_aggregate_are_written_by_many_tasks(spark):
    from checks import tables

    names_ = spark.range(3000).selectExpr("concat('d', id % 3) dir_name", "concat('f', id % 1000) file_name")
    found = tables.dealt(names_).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in found) == 3000 and len(found) > 1
    twice = tables.dealt(names_.unionByName(names_)).mapInArrow(lambda batches: batches, "dir_name string, file_name string")
    assert twice.count() == 3000
