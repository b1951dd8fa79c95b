"""STR6: live tail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.functions import text
from tideline.plans import route
from tideline.sources import streams


def live_tail(spark: SparkSession, publishers: Sequence[str], prefixes: Sequence[str],
              max_files: int | None = None) -> DataFrame:
    """Non-empty lines of all publishers whose topic begins with a prefix.

    A narrow stream: no shuffle and no state.
    """
    lines = streams.topic_lines(spark, publishers, max_files)
    return route.tail(lines.where(text.non_blank(F.col("line"))), prefixes)


def start_tail(tail: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = tail.writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint
    )
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.start()
