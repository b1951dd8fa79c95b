"""JOB9: route lines into topics and deliver them to prefix subscriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators.joins import join_keyed, settled

ROUTES = (("^ERROR", "errors"),)


def routed(lines: DataFrame, service: Column, host: Column,
           rules: Sequence[tuple[str, str]] = ROUTES, default: str = "main") -> DataFrame:
    """FLT10 + FLT11: non-empty lines with topic ``service.stream.host``."""
    stream = text.route(F.col("line"), rules, default)
    return lines.where(text.non_blank(F.col("line"))).withColumn(
        "topic", F.concat_ws(".", service, stream, host)
    )


def tail(topic_lines: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """FLT9 for a handful of prefixes: a filter, batch or stream."""
    return topic_lines.where(text.subscribed(F.col("topic"), prefixes))


def tail_subscriptions(topic_lines: DataFrame, prefixes: DataFrame) -> DataFrame:
    """FLT9 for a table of prefixes: lines whose topic begins with any of them.

    Prefix matching becomes equality: the distinct topics are cut to the prefix
    lengths in use and looked up. Lines meet only the list of matching topics, by
    a semi-join on the topic, so each passes once. Batch.
    """
    wanted = settled(prefixes.select("prefix").distinct())
    # As many numbers as there are prefix lengths, whatever the number of prefixes.
    lengths = sorted(r[0] for r in wanted.select(F.length("prefix")).distinct().collect())
    topics = topic_lines.select("topic").distinct()
    cuts = topics.select(
        "topic", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n")
    ).where(F.col("n") <= F.length("topic")).withColumn(
        "prefix", F.substr("topic", F.lit(1), F.col("n"))
    )
    matching = cuts.join(wanted, "prefix", "left_semi").select("topic").distinct()
    return join_keyed(topic_lines, matching, ["topic"], "left_semi")


def write_topics(routed_lines: DataFrame, path: str) -> None:
    """One directory per topic; a rebalance merges crumbs and splits hot topics."""
    routed_lines.hint("rebalance", "topic").write.partitionBy("topic").parquet(path)
