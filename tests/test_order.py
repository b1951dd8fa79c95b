"""The certificate of order, and line numbers of large files."""

import random

from pyspark.sql import functions as F

from tests.test_files import NOW, put
from tideline.operators import order
from tideline.sources import files


def test_certificate_sees_every_fall(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "ä", "", None, "zz"]) if i % 3 else f"{i:05}",) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string")
    whole = order.ranged(df, "k", 7)
    assert tuple(order.certificate(whole, "k").first()) == (2000, 0, 0)
    mixed = df.repartition(5).collect()
    again = spark.createDataFrame(mixed, "k string").coalesce(1)
    null_first = [(r.k is not None, (r.k or "").encode()) for r in mixed]
    falls = sum(a > b for a, b in zip(null_first, null_first[1:]))
    assert tuple(order.certificate(again, "k").first()) == (2000, falls, 0)
    swapped = spark.range(0, 4, 1, 2).select(F.element_at(F.array(*map(F.lit, "mnbc")), (F.col("id") + 1).cast("int")).alias("k"))
    assert tuple(order.certificate(swapped, "k").first()) == (4, 0, 1)
    assert tuple(order.certificate(df.limit(0), "k").first()) == (0, 0, 0)


def test_line_numbers_of_a_file_in_many_splits(spark, tmp_path):
    root = str(tmp_path)
    big = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(4000)).encode()
    put(root, "s@main@h", NOW, big)
    put(root, "s@main@h", NOW - 1, b"only")
    put(root, "t@main@h", NOW, b"a\n\nb\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = files.log_lines(spark, root)
        assert lines.select("block").distinct().count() > 5
        got = files.numbered_lines(lines)
        big_rows = got.where((F.col("service") == "s") & F.col("line").startswith("line")).orderBy("line_no").collect()
        assert [(r.line_no, r.line.split()[1]) for r in big_rows] == [(i, str(i)) for i in range(4000)]
        rest = got.where(~F.col("line").startswith("line")).collect()
        assert sorted((r.service, r.line_no, r.line) for r in rest) == [("s", 0, "only"), ("t", 0, "a"), ("t", 1, ""), ("t", 2, "b")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
