import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tests import reference_model as model
from tideline.functions import labels

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def ms_of(day):
    return labels._epoch_ms(day)


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "ms bigint")


def round_trip(spark, values):
    label = labels.encode_ms(F.col("ms"))
    df = frame(spark, values).select("ms", label.alias("label")).select(
        "ms", "label", labels.decode_ms(F.col("label")).alias("back"))
    return df.collect()


def test_round_trip_over_sixty_years(spark):
    rng = random.Random(7)
    values = [rng.randint(1, 60 * 365 * 86400) * 1000 for _ in range(2000)]
    for row in round_trip(spark, values):
        assert row.label == model.encode(row.ms)
        assert len(row.label) == 24
        assert row.back == model.decode(row.label)


def test_one_second_early_before_each_boundary(spark):
    for (day, new), (_, old) in zip(labels.LEAP_TABLE[1:], labels.LEAP_TABLE):
        at = ms_of(day)
        rows = round_trip(spark, [at - old * 1000, at - (old - 1) * 1000, at, at + 1, at + 1000])
        back = {r.ms: r.back for r in rows}
        assert back[at - old * 1000] == at - old * 1000
        assert back[at - (old - 1) * 1000] == at - (old - 1) * 1000 - 1000
        assert back[at] == at - 1000
        assert back[at + 1] == at + 1
        assert back[at + 1000] == at + 1000


def test_offset_applies_strictly_after_its_instant(spark):
    at = ms_of("2012-07-01")
    got = frame(spark, [at, at + 1, ms_of("1972-01-01"), ms_of("1972-01-01") + 1, 0]).select(
        labels.leap_offset(F.col("ms"))).collect()
    assert [r[0] for r in got] == [34, 35, 0, 10, 0]


def test_table_can_be_extended(spark):
    longer = (*labels.LEAP_TABLE, ("2015-07-01", 36))
    at = ms_of("2016-01-01")
    df = frame(spark, [at])
    assert df.select(labels.leap_offset(F.col("ms"))).first()[0] == 35
    assert df.select(labels.leap_offset(F.col("ms"), longer)).first()[0] == 36


def test_milliseconds_survive_and_nanoseconds_truncate(spark):
    df = spark.createDataFrame([("4000000065a0314e04d3f640",), ("4000000065a0314e04d3ffff",)],
                               "label string")
    got = [r[0] for r in df.select(labels.decode_ms(F.col("label"))).collect()]
    assert got[0] == got[1] == model.decode("4000000065a0314e04d3f640")
    assert got[0] % 1000 == 0x04d3f640 // 1_000_000


def test_malformed_labels_are_null(spark):
    bad = ["", "zz", "40000000zz", "4000000065A0314E04D3F640", "4000000065a0314e04d3f64",
           "4000000065a0314e04d3f6400", None]
    df = spark.createDataFrame([(b,) for b in bad], "label string")
    assert {r[0] for r in df.select(labels.decode_ms(F.col("label"))).collect()} == {None}


def test_label_of_rotated_name(spark):
    df = spark.createDataFrame(
        [("@4000000065a0314e04d3f640.s",), ("@4000000065a0314e04d3f640.u",), ("current",),
         ("@x",)], "file_name string")
    name = F.col("file_name")
    got = df.select(labels.label_of(name), labels.is_rotated_name(name)).collect()
    assert got[0] == ("4000000065a0314e04d3f640", True)
    assert len(got[0][0]) == 24
    assert [r[1] for r in got] == [True, True, False, False]


def test_first_label_at_is_the_exact_bound():
    rng = random.Random(3)
    limits = [ms_of("2024-01-27"), ms_of("2012-07-01"), ms_of("1999-01-01") - 500, 0]
    limits += [rng.randint(0, ms_of("2024-01-01")) for _ in range(200)]
    for limit in limits:
        bound = labels.first_label_at(limit)
        assert model.decode(bound) >= limit
        seconds, ms = divmod((int(bound[:16], 16) - labels.TAI_BASE) * 1000
                             + int(bound[16:], 16) // 1_000_000 - 1, 1000)
        before = f"{seconds + labels.TAI_BASE:016x}{ms * 1_000_000:08x}"
        assert model.decode(before) < limit


def test_floor_to_ms(spark):
    df = spark.createDataFrame([("4000000065a0314e04d3ffff",)], "label string")
    floored = df.select(labels.floor_to_ms(F.col("label"))).first()[0]
    assert floored == f"4000000065a0314e{0x04d3ffff // 1_000_000 * 1_000_000:08x}"


def test_timestamp_form(spark):
    at = EPOCH + timedelta(days=19000, milliseconds=123)
    df = spark.createDataFrame([(at,)], "ts timestamp")
    label = df.select(labels.encode(F.col("ts"))).first()[0]
    assert label == model.encode(19000 * 86_400_000 + 123)
