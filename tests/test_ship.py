import pytest
from pyspark.sql import functions as F

from tests import reference_model as model
from tideline.operators import inventory, watermark
from tideline.plans import compact, retain, ship

AS_OF = "2024-01-31 12:00:00"
NOW = inventory.clock_ms(AS_OF)
HOUR, DAY = 3_600_000, 86_400_000


def name(ms):
    return f"@{model.encode(ms)}.s"


def files(spark, rows):
    return inventory.usable(spark.createDataFrame(
        rows, "service string, category string, host string, file_name string, size_bytes bigint"))


def archive(spark, rows):
    df = spark.createDataFrame(rows, "d string, service string, host string, taistamp string")
    return df.select(F.col("d").cast("date").alias("dir_date"), "service", "host", "taistamp")


def one_plan(spark, file_rows, archive_rows, **kw):
    found = files(spark, file_rows)
    plan = ship.ship_plan(found, archive(spark, archive_rows), AS_OF, **kw)
    return found, plan


def test_nothing_shipped_yet(spark):
    found, plan = one_plan(spark, [("s", "main", "h", name(NOW - HOUR), 10)], [])
    row = plan.first()
    assert (row.decision, row.ships, row.last_taistamp) == ("first", True, None)
    assert (row.target_dir, row.temp_dir) == ("2024/01-31", "tmp/")
    assert ship.outstanding(found, plan, AS_OF).count() == 1


def test_something_shipped_and_throttled(spark):
    rows = [("s", "main", "h", name(NOW - i * HOUR), 10) for i in range(6)]
    shipped = [("2024-01-31", "s", "h", model.encode(NOW - 3 * HOUR))]
    found, plan = one_plan(spark, rows, shipped, interval_seconds=3 * 3600)
    assert plan.first().decision == "interval"
    got = {r.file_name for r in ship.outstanding(found, plan, AS_OF).collect()}
    assert got == {name(NOW), name(NOW - HOUR), name(NOW - 2 * HOUR)}
    _, plan = one_plan(spark, rows, shipped, interval_seconds=3 * 3600 + 1)
    row = plan.first()
    assert (row.decision, row.error_kind, row.ships) == ("throttled", "sync_throttled", False)
    assert ship.outstanding(found, plan, AS_OF).count() == 0
    _, plan = one_plan(spark, rows, shipped, interval_seconds=10**6, max_ready_bytes=59)
    assert plan.first().decision == "size"
    _, plan = one_plan(spark, rows, shipped, interval_seconds=10**6, max_ready_bytes=60)
    assert plan.first().decision == "throttled"


def test_future_label_is_throttled_with_its_own_error(spark):
    rows = [("s", "main", "h", name(NOW), 10)]
    _, plan = one_plan(spark, rows, [("2024-01-31", "s", "h", model.encode(NOW + HOUR))],
                       max_ready_bytes=1)
    assert (plan.first().decision, plan.first().error_kind) == ("throttled", "future_label")


def test_watermark_is_the_newest_directory_not_the_greatest_label(spark):
    rows = [("s", "main", "h", name(NOW - 2 * DAY), 1)]
    placed = [("2024-01-31", "s", "h", model.encode(NOW - 30 * HOUR)),
              ("2024-01-31", "s", "h", model.encode(NOW - 40 * HOUR)),
              ("2024-01-30", "s", "h", model.encode(NOW - 2 * HOUR)),
              ("2024-01-31", "s", "other", model.encode(NOW))]
    _, plan = one_plan(spark, rows, placed)
    assert plan.first().last_taistamp == model.encode(NOW - 30 * HOUR)
    marks = {r.host: r.last_taistamp for r in watermark.watermarks(archive(spark, placed)).collect()}
    assert marks["h"] == model.encode(NOW - 30 * HOUR)


def test_look_back_reaches_the_lower_bounds_own_day(spark):
    def last(oldest_ms, dir_day):
        rows = [("s", "main", "h", name(oldest_ms), 1)]
        _, plan = one_plan(spark, rows, [(dir_day, "s", "h", model.encode(NOW - 5 * DAY))])
        return plan.first().last_taistamp

    assert last(NOW - 10 * DAY, "2024-01-28") is not None
    assert last(NOW - 10 * DAY, "2024-01-27") is None
    assert last(NOW - HOUR, "2024-01-30") is None
    assert last(NOW - HOUR, "2024-01-31") is not None
    assert last(NOW - 13 * HOUR, "2024-01-30") is not None
    assert last(NOW - 10 * DAY, "2024-02-01") is None


def test_categories_share_a_watermark_but_ship_apart(spark):
    rows = [("s", "a", "h", name(NOW - 2 * HOUR), 1), ("s", "b", "h", name(NOW - HOUR), 1)]
    found, plan = one_plan(spark, rows, [("2024-01-31", "s", "h", model.encode(NOW - 90 * 60_000))],
                           interval_seconds=60)
    assert plan.count() == 2
    assert [r.category for r in ship.outstanding(found, plan, AS_OF).collect()] == ["b"]
    late = ship.late_files(found, plan, AS_OF).collect()
    assert [(r.category, r.reason) for r in late] == [("a", "behind_watermark")]
    assert ship.nothing_to_sync(plan, ship.outstanding(found, plan, AS_OF)).first().category == "a"


def test_age_limit_is_midnight_four_days_ago(spark):
    midnight = inventory.clock_ms("2024-01-27 00:00:00")
    rows = [("s", "main", "h", name(ms), 1) for ms in (midnight - 1, midnight, NOW)]
    found, plan = one_plan(spark, rows, [])
    assert {r.file_name for r in ship.outstanding(found, plan, AS_OF).collect()} == {
        name(midnight), name(NOW)}
    assert [r.reason for r in ship.late_files(found, plan, AS_OF).collect()] == ["too_old"]


def test_ledger_closes_the_look_back_hole(spark):
    rows = [("s", "main", "h", name(NOW - h * HOUR), 1) for h in (80, 60, 1)]
    found, plan = one_plan(spark, rows, [])
    marks = spark.createDataFrame([("s", "h", model.encode(NOW - 60 * HOUR))],
                                  "service string, host string, ledger_label string")
    assert ship.outstanding(found, plan, AS_OF).count() == 3
    got = ship.outstanding(found, plan, AS_OF, shipped=marks).collect()
    assert [r.file_name for r in got] == [name(NOW - HOUR)]


def test_bad_names_are_set_aside_or_raise(spark):
    raw = spark.createDataFrame(
        [("s", "main", "h", n, 1) for n in (name(NOW), "current", ".hidden", "@zz.s")],
        "service string, category string, host string, file_name string, size_bytes bigint")
    assert inventory.usable(raw).count() == 1
    assert {r.file_name for r in inventory.quarantine(raw).collect()} == {"current", "@zz.s"}
    with pytest.raises(Exception, match="bad rotated file name"):
        inventory.usable(raw, strict=True).collect()


def test_cleanup_limit_after_success_and_after_failure(spark):
    rows = [("s", "main", h, name(NOW - d * DAY), 100) for h in ("a", "b") for d in range(1, 9)]
    found = files(spark, rows)
    out = found.where("host = 'a'").where(F.col("label") >= model.encode(NOW - 3 * DAY))
    flagged = retain.retention_manifest(found, compact.batches(out), AS_OF, min_bytes=0)
    kept = {h: sorted(r.file_name for r in flagged.where(~F.col("to_delete") & (F.col("host") == h))
                      .collect()) for h in ("a", "b")}
    # a shipped its newest file, so everything before it may go; b keeps 4 days.
    assert kept["a"] == [name(NOW - DAY)]
    assert kept["b"] == sorted(name(NOW - d * DAY) for d in range(1, 5))
