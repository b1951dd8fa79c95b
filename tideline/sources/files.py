"""SRC1-SRC4: rotated files, service directories, archive listing, log lines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import names, predicates
from tideline.operators import inventory
from tideline.operators.joins import join_keyed, settled
from tideline.session import qualified
from tideline.sources import reading, walk

# Files that one task opens at most, however small they are.
FILES_A_TASK = 4096


def _part(path: Column, from_end: int) -> Column:
    return F.element_at(F.split(path, "/", -1), -from_end)


def _decoded(path: Column) -> Column:
    """File metadata paths are URL encoded; a plus sign is not a blank there."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def _listed(entries: DataFrame) -> DataFrame:
    """Rows of :func:`walk.entries`; a directory that can't be listed is an error."""
    failed = F.raise_error(F.concat(F.lit("can't list "), F.col("path"), F.lit(": "), F.col("error")))
    return entries.select(
        "dir_name", F.when(F.col("error").isNull(), F.col("file_name")).otherwise(failed).alias("file_name"),
        "size_bytes", "path")


def rotated_files(spark: SparkSession, root: str | list[str],
                  exclude: Sequence[str] = predicates.HIDDEN_FILES) -> DataFrame:
    """SRC1: inventory of ``root/<service@category@host>/<file>``, empty files included.

    Only names and lengths are read, by tasks that share the directories. Files in
    directories that are not a service directory have ``dir_ok`` false. What vanishes
    while the listing runs is left out; a directory that can't be listed fails the job
    (:func:`tideline.sources.index.advance` records it instead).
    """
    listing = _listed(walk.entries(walk.directories(spark, root)))
    return names.with_service_identity(listing.where(~predicates.excluded(F.col("file_name"), exclude)))


def service_dirs(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """SRC2: every directory of the spool with its identity, empty ones included."""
    return inventory.service_dirs(walk.directories(spark, root))


def archive_files(spark: SparkSession, root: str, days: Sequence[str] | None = None) -> DataFrame:
    """SRC3: (dir_date, file_name) of ``root/YYYY/MM-DD/<archive name>``.

    ``days`` (``YYYY-MM-DD``) restricts the listing itself to the look-back; a day
    without a directory counts as empty, and so does an archive without any.
    """
    if days is None:
        pattern = f"{root}/[0-9]*/[0-9]*-[0-9]*/*"
    else:
        paths = [d.replace("-", "/", 1) for d in days]
        pattern = f"{root}/{{{','.join(paths)}}}/*"
    try:
        found = spark.read.format("binaryFile").load(pattern).select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], "path string")
    day = F.concat_ws("-", _part(F.col("path"), 3), _part(F.col("path"), 2))
    return found.select(day.try_cast("date").alias("dir_date"),
                        _part(F.col("path"), 1).alias("file_name"))


def lookback_days(as_of: str, days: int) -> list[str]:
    """The day directories a listing has to visit for a look-back of ``days``."""
    from datetime import date, timedelta

    today = date.fromisoformat(as_of[:10])
    return [str(today - timedelta(days=n)) for n in range(days + 1)]


def _folders(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """``dir_name`` and ``path`` of the folders of a root, or of those in a list."""
    if isinstance(root, str):
        return walk.directories(spark, root)
    found = [(path.rstrip("/").rsplit("/", 1)[-1], qualified(spark, path)) for path in root]
    return spark.createDataFrame(found, "dir_name string, path string")


def log_lines(spark: SparkSession, root: str | list[str],
              from_name: str | None = None) -> DataFrame:
    """SRC4: the lines of all rotated files, in no particular row order.

    Of a single root all service directories are read, of a list of folders each as it is; only files
    directly in them, and none that begin with ``_`` or a dot. ``from_name`` is a constant lower
    bound on the file name: files below it are not opened. For the rest see :func:`lines_of`.
    """
    service = names.with_service_identity(_folders(spark, root)).where("dir_ok")
    found = _listed(walk.entries(service)).where(~F.col("file_name").rlike("^[_.]"))
    if from_name is not None:
        found = found.where(F.col("file_name") >= from_name)
    return lines_of(names.with_service_identity(found))


def lines_of(found: DataFrame) -> DataFrame:
    """The lines of the files in ``found``: directory keys, ``file_name``, ``path``, ``size_bytes``.

    ``block`` and ``pos`` order the lines of a file: the byte where the range
    starts, and the line's number in the range. Files of any size are thus
    read in parallel and still have an exact line order. Tasks open the files, thousands of
    small ones each: the driver keeps no list of them. A file that has gone since it was listed has no
    lines, one that has grown is read to its end.
    """
    spark = found.sparkSession
    step = range_bytes(spark)
    size = F.when(reading.packed(F.col("file_name")), 0).otherwise(F.coalesce("size_bytes", F.lit(0))).cast("bigint")
    sized = found.select(*inventory.DIR_KEYS, "file_name", "path", size.alias("size"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(step).cast("bigint"))
    ranges = settled(sized.select("*", F.explode(starts).alias("block")))
    total = ranges.agg(F.count("*"), F.sum(F.least(F.col("size") - F.col("block"), F.lit(step)))).first()
    least = min(total[0], int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = max(1, least, math.ceil(total[0] / FILES_A_TASK), math.ceil((total[1] or 0) / step))
    end = F.when(F.col("block") + step < F.col("size"), F.col("block") + step)
    dealt = ranges.select(*inventory.DIR_KEYS, "file_name", "path", "block", end.alias("end")).repartition(tasks)
    return dealt.mapInArrow(reading.read_ranges, reading.LINES)


def range_bytes(spark: SparkSession) -> int:
    """Bytes of a file that are read in one go: ``spark.sql.files.maxPartitionBytes``."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``line_no`` from 0 within each file of :func:`log_lines`, however large the file is.

    Lines are counted per split first; a line's number is the sum of the splits before its own,
    over one row per split, and its rank within its split.
    """
    file = [*inventory.DIR_KEYS, "file_name"]
    counts = lines.groupBy(*file, "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*file).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*file, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*file, "block").orderBy("pos")
    ranked = lines.withColumn("_rank", F.row_number().over(inside))
    return join_keyed(ranked, bases, [*file, "block"], "inner").withColumn(
        "line_no", (F.col("base") + F.col("_rank") - 1).cast("bigint")).drop("base", "_rank")
