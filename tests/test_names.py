from pyspark.sql import functions as F

from tideline.functions import names, predicates, telemetry, text
from tideline.plans import catalogue, problems


def test_service_identity_needs_exactly_three_parts(spark):
    dirs = ["a@b@c", "a@b@", "a@b", "a@b@c@d", "@b@c", "a@@c", "plain", "@@c"]
    df = names.with_service_identity(spark.createDataFrame([(d,) for d in dirs], "dir_name string"))
    ok = {r.dir_name for r in df.where("dir_ok").collect()}
    assert ok == {"a@b@c", "@b@c", "a@@c", "@@c"}
    row = df.where("dir_name = 'a@b@c'").first()
    assert (row.service, row.category, row.host) == ("a", "b", "c")


def test_destination_key_is_the_inverse(spark):
    df = spark.createDataFrame([("s", "c", "h")], "service string, category string, host string")
    assert df.select(names.destination_key(F.col("service"), F.col("category"), F.col("host"))
                     ).first()[0] == "s@c@h"


def test_archive_names_parse_greedily_and_anchored(spark):
    good = "2024,01,30,svc,h1,4000000065a0314e04d3f640.seq"
    cases = {
        good: ("svc", "h1"),
        "2024,01,30,a,b,h1,4000000065a0314e04d3f640.seq": ("a,b", "h1"),
        "2024,01,30,svc,h1,4000000065a0314e04d3f640xseq": ("svc", "h1"),
        "x" + good: None,
        good + "x": None,
        "2024,1,30,svc,h1,40.seq": None,
        "tmp": None,
    }
    df = spark.createDataFrame([("2024-01-31", n) for n in cases], "d string, file_name string")
    parsed = catalogue.parse_catalogue(df.select(F.col("d").cast("date").alias("dir_date"),
                                                 "file_name"))
    for row in parsed.collect():
        want = cases[row.file_name]
        assert row.name_ok == (want is not None)
        if want:
            assert (row.service, row.host) == want
            assert str(row.name_date) == "2024-01-30"
    assert catalogue.quarantine(parsed).count() == 4
    found = problems.bad_archive_names(parsed)
    assert [tuple(r) for r in problems.report(found).collect()] == [(None, "invalid_archive_name", 4, found.select("dir_name").distinct().count())]
    verdict = catalogue.day_verdicts(parsed).first()
    assert (verdict.n_values, verdict.n_errors, verdict.is_valid) == (3, 4, False)


def test_archive_name_round_trip(spark):
    df = spark.createDataFrame([("4000000065a0314e04d3f640",)], "label string")
    name = df.select(names.archive_name(F.col("label"), F.lit("svc"), F.lit("h1"))).first()[0]
    assert name == "2024,01,11,svc,h1,4000000065a0314e04d3f640.seq"


def test_day_path(spark):
    df = spark.sql("SELECT timestamp'2024-03-01 00:30:00' AS ts")
    row = df.select(names.day_path(names.day_bucket(F.col("ts"))),
                    names.day_path(names.day_bucket(F.col("ts"), 1))).first()
    assert tuple(row) == ("2024/03-01", "2024/02-29")


def test_exclusions_match_the_whole_name(spark):
    df = spark.createDataFrame([(n,) for n in (".a", "a.b", "x.tmp", "x.tmp.s", "tmp")],
                               "n string")
    kept = df.where(~predicates.excluded(F.col("n"), (r"\..*", r".*\.tmp"))).collect()
    assert {r.n for r in kept} == {"a.b", "x.tmp.s", "tmp"}
    assert df.where(~predicates.excluded(F.col("n"), ())).count() == 5


def test_agent_exclusions(spark):
    df = spark.createDataFrame([(n,) for n in ("config", "current", "lock", "@1.u", "x~", "@1.s",
                                               "locks")], "n string")
    assert {r.n for r in df.where(~predicates.agent_excluded(F.col("n"))).collect()} == {
        "@1.s", "locks"}
    assert {r.n for r in df.where(~predicates.agent_excluded(F.col("n"), True)).collect()} == {
        "@1.u", "x~", "@1.s", "locks"}


def test_decision_edges(spark):
    day = 86_400_000
    rows = [
        ("never", None, 0), ("exact", day - 60_000, 0), ("short", day - 60_000 + 1, 0),
        ("big", day - 1000, 101), ("at limit", day - 1000, 100), ("future", day + 1, 10_000),
    ]
    df = spark.createDataFrame(rows, "name string, last bigint, ready bigint")
    got = {r[0]: r[1] for r in df.select("name", predicates.ship_decision(
        F.col("last"), F.lit(day), 60, F.col("ready"), 100)).collect()}
    assert got == {"never": "first", "exact": "interval", "short": "throttled", "big": "size",
                   "at limit": "throttled", "future": "throttled"}


def test_utf8_repair(spark):
    cases = {
        b"plain": "plain", "grün".encode(): "grün", b"\xff": "?", b"a\xc3": "a?",
        b"\xe2\x82A": "?A", b"ok\xf0\x9f\x98": "ok?", "�".encode(): "�", b"": "",
        b"\xc3\x28": "?(", b"\xff\xfe": "??",
    }
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "b binary")
    got = df.select("b", text.repair_utf8(F.col("b").cast("string")).alias("line")).collect()
    for row in got:
        assert row.line == cases[bytes(row.b)], bytes(row.b)


def test_lines_of_whole_texts(spark):
    cases = {"a\nb": ["a", "b"], "a\r\nb\rc\n": ["a", "b", "c"], "a\n\nb\n\n": ["a", "", "b", ""],
             "": [], "\n": [""], "x": ["x"]}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "id int, text string")
    got = {i: [] for i in range(len(cases))}
    for row in sorted(text.split_text(df).collect(), key=lambda r: r.line_no):
        got[row.id].append(row.line)
    assert list(got.values()) == list(cases.values())


def test_tagging_drops_empty_lines(spark):
    df = spark.createDataFrame([("a\n\nb\r\n",)], "chunk string")
    assert [r.line for r in text.tag_lines(df, F.lit("t")).collect()] == ["a", "b\r"]


def test_routing_and_subscription(spark):
    df = spark.createDataFrame([("ERROR x",), ("an ERROR",), ("fine",)], "line string")
    assert [r[0] for r in df.select(text.route(F.col("line"))).collect()] == [
        "errors", "main", "main"]
    topics = spark.createDataFrame(
        [("myservice.main.h1",), ("myservice.errors.h3",), ("other.main.h1",), ("my",)],
        "topic string")

    def hit(*p):
        return {r[0] for r in topics.where(text.subscribed(F.col("topic"), p)).collect()}

    assert hit("myservice") == {"myservice.main.h1", "myservice.errors.h3"}
    assert hit("myservice.main", "myservice.errors.h3", "myservice") == hit("myservice")
    assert hit("") == {r[0] for r in topics.collect()}
    assert hit() == set()


def test_telemetry_parsing(spark):
    cases = ["svc main k 3", " svc  main\tk   -4 tail", "svc main k x", "svc main k", "", "1 2 3 4.5"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "ts int, value string")
    rows = telemetry.parse(df).orderBy("ts").collect()
    assert [r.report_ok for r in rows] == [True, True, False, False, False, False]
    assert [r.amount for r in rows[:2]] == [3, -4]
    assert rows[1].key == "k"
    assert telemetry.bad_reports(telemetry.parse(df)).count() == 4
