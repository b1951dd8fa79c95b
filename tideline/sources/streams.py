"""SRC1 / SRC5 / SRC6 as Structured Streaming sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import names, predicates
from tideline.sources.files import _decoded, _part

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def new_rotated_files(spark: SparkSession, root: str, max_files: int | None = None,
                      exclude: Sequence[str] = predicates.HIDDEN_FILES) -> DataFrame:
    """SRC1 as a stream: every rotated file once, names and sizes only.

    Each folder of ``root`` is listed by its own name, as Spark passes over those that begin with ``_``.
    """
    reader = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", True)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    listing = reader.load(f"{root}/*").select(
        _part(F.col("path"), 2).alias("dir_name"),
        _part(F.col("path"), 1).alias("file_name"),
        F.col("length").alias("size_bytes"),
    )
    return names.with_service_identity(
        listing.where(~predicates.excluded(F.col("file_name"), exclude))
    ).where("dir_ok").select("service", "category", "host", "file_name", "size_bytes")


def telemetry(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """SRC5: records ``<epoch ms> <service> <category> <key> <value>``, one per line.

    The stamp is the time the collector received the record. A line without one
    has a NULL ``ts``.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    words = F.split("value", " ", 2)
    return reader.text(root).select(
        F.timestamp_millis(F.get(words, F.lit(0)).try_cast("bigint")).alias("ts"),
        F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("value"),
    )


def topic_lines(spark: SparkSession, publishers: Sequence[str],
                max_files: int | None = None) -> DataFrame:
    """SRC6: lines of many publishers as one stream.

    A publisher directory holds one sub-directory per topic, named by it with or
    without a leading ``topic=``; all are merged.
    """
    def one(root: str) -> DataFrame:
        reader = spark.readStream.option("recursiveFileLookup", True)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.text(root).select(
            F.regexp_replace(_part(_decoded(F.col("_metadata.file_path")), 2), "^topic=", "")
            .alias("topic"),
            F.col("value").alias("line"),
        )

    return reduce(DataFrame.unionByName, [one(p) for p in publishers])
