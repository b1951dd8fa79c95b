import random

import pytest
from pyspark.sql import functions as F

from tests import reference_model as model
from tideline.operators import inventory, retention

NOW = 1_706_659_200_000


def run(spark, dirs, limits, floors, **kw):
    rows = [(s, "main", "h", f"@{label}.s", size) for s, fs in dirs.items() for label, size in fs]
    found = inventory.usable(spark.createDataFrame(
        rows, "service string, category string, host string, file_name string, size_bytes bigint"))
    bounds = spark.createDataFrame(
        [(s, "main", "h", model.encode(limits[s]), floors[s]) for s in dirs],
        "service string, category string, host string, limit_label string, floor bigint")
    flagged = retention.manifest(found, bounds, min_bytes=F.col("floor"), **kw)
    got = {s: [] for s in dirs}
    for r in flagged.where("to_delete").collect():
        got[r.service].append(r.label)
    return flagged, {s: sorted(v) for s, v in got.items()}


def random_dirs(rng, n_dirs, hot):
    dirs = {}
    for d in range(n_dirs):
        n = hot if d == 0 else rng.randint(1, 30)
        times = rng.sample(range(NOW - 3 * 3_600_000, NOW), n)
        dirs[f"s{d}"] = [(model.encode(t), rng.choice([0, 1, 5, 1000])) for t in times]
    return dirs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_fold_with_one_hot_directory(spark, seed):
    rng = random.Random(seed)
    dirs = random_dirs(rng, 40, 400)
    limits = {s: NOW - rng.randint(0, 4 * 3_600_000) for s in dirs}
    floors = {s: rng.choice([0, 1, 1000, 3000, 10**6]) for s in dirs}
    want = {s: model.retention(fs, limits[s], floors[s]) for s, fs in dirs.items()}
    _, got = run(spark, dirs, limits, floors)
    assert got == want
    assert sum(map(len, want.values())) > 50


def test_the_cut_is_found_within_one_second(spark):
    rng = random.Random(9)
    dirs = {f"s{d}": [(model.encode(NOW - t), rng.choice([0, 1, 5, 1000])) for t in rng.sample(range(span), 90)]
            for d, span in enumerate((100, 900, 5_000, 60_000, 5_000_000))}
    limits = {s: NOW for s in dirs}
    floors = {s: 2000 for s in dirs}
    want = {s: model.retention(fs, limits[s], floors[s]) for s, fs in dirs.items()}
    assert run(spark, dirs, limits, floors)[1] == want


def test_floor_is_strict_and_newest_file_stays(spark):
    a, b, c = (model.encode(NOW - d) for d in (3000, 2000, 1000))
    dirs = {"s": [(a, 10), (b, 10), (c, 10)]}
    assert run(spark, dirs, {"s": NOW}, {"s": 30})[1] == {"s": []}
    assert run(spark, dirs, {"s": NOW}, {"s": 29})[1] == {"s": [a]}
    flagged, got = run(spark, dirs, {"s": NOW}, {"s": 0})
    assert got == {"s": [a, b]}
    row = retention.summary(flagged).first()
    assert (row.n_deleted, row.kb_left) == (2, 0)
    assert run(spark, dirs, {"s": NOW - 2000}, {"s": 0})[1] == {"s": [a]}
