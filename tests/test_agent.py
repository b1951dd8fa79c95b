import pytest
from pyspark.sql import functions as F

from tideline.operators import gap

LOCAL = [str(i) for i in range(1, 9)]
CASES = {
    "all": (LOCAL, LOCAL),
    "none": ([], []),
    "one": (["8"], ["8"]),
    "weird gap": (["7"], []),
    "many": (["5", "6", "7", "8"], ["5", "6", "7", "8"]),
    "canonical": (["1", "2", "5", "7", "8"], ["7", "8"]),
}


def test_six_gap_cases_at_once(spark):
    local = spark.createDataFrame([(a, n) for a in CASES for n in LOCAL],
                                  "agent string, file_name string")
    missing = spark.createDataFrame([(a, n) for a, (m, _) in CASES.items() for n in m],
                                    "agent string, file_name string")
    got = {a: [] for a in CASES}
    for r in gap.beyond_gap(local, missing).collect():
        got[r.agent].append(r.file_name)
    assert {a: sorted(v) for a, v in got.items()} == {a: w for a, (_, w) in CASES.items()}


def listing(spark, local, missing):
    rows = [("a", "local", n) for n in local] + [("a", "missing", n) for n in missing]
    return spark.createDataFrame(rows, "agent string, side string, file_name string")


def test_half_written_file_hides_candidates_only_in_parity(spark):
    table = listing(spark, ["@1.s", "@2.s", "@3.u", "current", "lock"], ["@1.s", "@2.s", "sent"])
    got = {r.file_name for r in gap.sync_candidates(table).collect()}
    assert got == {"@1.s", "@2.s"}
    assert gap.sync_candidates(table, parity_exclusions=True).count() == 0


def test_multiset_difference(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")],
                               "agent string, file_name string")
    drop = spark.createDataFrame([("x",)], "file_name string")
    got = sorted(tuple(r) for r in gap.without_names(df, drop).collect())
    assert got == [("a", "x"), ("a", "y")]


def test_missing_members_keep_duplicates(spark):
    small = spark.createDataFrame([("a",), ("a",), ("b",)], "n string")
    big = spark.createDataFrame([("b",), ("c",)], "n string")
    assert [r.n for r in gap.missing_members(small, big, ["n"]).collect()] == ["a", "a"]


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 26])
def test_statistics(spark, broadcast_bytes):
    tried = spark.createDataFrame(
        [("a", 1, "f1", True), ("a", 1, "f2", True), ("a", 1, "f3", False),
         ("a", 2, "f4", True), ("a", 2, "f5", False)],
        "agent string, cycle bigint, file_name string, ok boolean")
    after = spark.createDataFrame([("a", 1, "f1"), ("a", 2, "f4"), ("a", 2, "f5")],
                                  "agent string, cycle bigint, file_name string")
    rows = {r.cycle: r for r in gap.ship_statistics(tried, after).collect()}
    assert rows[1].asDict() == {"agent": "a", "cycle": 1, "num_shipped": 3, "num_delivered": 2,
                                "num_rotated": 2, "num_lost": 1, "aborted": False}
    assert rows[2].aborted


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 26])
def test_keyed_join_gives_the_same_with_and_without_broadcast(spark, broadcast_bytes):
    from tideline.operators.joins import join_keyed

    big = spark.range(3000).select((F.col("id") % 3 * F.col("id")).alias("k"), "id")
    small = spark.range(0, 3000, 2).select(F.col("id").alias("k"), F.lit("x").alias("tag"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    joined = join_keyed(big, small, ["k"], "left", broadcast_bytes)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert ("BroadcastHashJoin" in plan) == bool(broadcast_bytes)
    assert joined.count() == 3000
    assert joined.where("tag IS NOT NULL").count() == sum(
        1 for i in range(3000) if i % 3 * i < 3000 and i % 3 * i % 2 == 0)
