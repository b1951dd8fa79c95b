"""Registered queries against their SQL twins at the smallest scale."""

import os

import pytest
from pyspark.sql import functions as F

from checks import compare
from checks.oracles import oracle_sql
from checks.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUICK = ["prj2_label_time", "prj6_archive_parse", "job1_ship_plan", "job2_outstanding",
         "job3_merged_lines", "job5_agent_candidates", "job7_telemetry", "job9_subscriptions"]


def test_every_query_has_a_twin():
    assert set(oracle_sql()) == set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("TEST_ALL_QUERIES") else QUICK)
def test_query_equals_its_twin(spark, name):
    assert compare.mismatch(spark, compare.database(SF), SF, name) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["job1_ship_plan", "job5_agent_candidates",
                                  "job9_subscriptions"])
def test_plans_have_no_cross_join_and_no_row_udf(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "NestedLoop", "BatchEvalPython"):
        assert word not in plan


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The smallest tables with every event twelve times, at ids side by side."""
    root = tmp_path_factory.mktemp("repeated")
    for table in compare.TABLES:
        if table != "events":
            os.symlink(f"{SF}/{table}.parquet", root / f"{table}.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet")
    copies = events.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(11))))
    copies.withColumn("event_id", F.col("event_id") * 12 + F.col("_copy")).drop("_copy").coalesce(1).write.parquet(
        str(root / "written"))
    [part] = (root / "written").glob("*.parquet")
    os.symlink(part, root / "events.parquet")
    return str(root)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["agg6_zero_fill", "agg7_ship_statistics", "jn3_missing", "job6_ship_stats"])
def test_repeated_events_equal_the_twin(spark, repeated, name):
    assert compare.mismatch(spark, compare.database(repeated), repeated, name) is None
