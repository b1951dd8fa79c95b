"""Engine input tables derived by Spark from the driver's parquet tables.

The number of rotated files, lines, records and events grows with the tables. The
clock is fixed: ``events`` ends on 2024-01-30.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import labels, names
from tideline.operators import inventory
from tideline.session import scratch_dir

AS_OF = "2024-01-31 00:00:00"
AS_OF_MS = 1_706_659_200_000
SHIP_INTERVAL = 129_600
EVENTS_PER_FILE = 64
DOC_BASE_MS = AS_OF_MS - 2 * 86_400_000
SHIPPED_DOCS = 100


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumns({
        "ts": F.col("ts").cast("timestamp"),
        "ms": F.unix_millis(F.col("ts").cast("timestamp")),
        "host": F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string")),
    })


def _rotated(spark: SparkSession, sf: str) -> DataFrame:
    grouped = events(spark, sf).groupBy(
        F.col("event_type").alias("service"), "host",
        F.expr(f"event_id div {EVENTS_PER_FILE}").alias("_chunk"),
    ).agg(
        F.max("ms").alias("ms"),
        F.sum(F.length("props") + F.length("event_type") + 20).cast("bigint").alias("size_bytes"),
    )
    return grouped.select(
        "service", F.lit("main").alias("category"), "host", "ms",
        labels.encode_ms(F.col("ms")).alias("label"), "size_bytes",
    )


def rotated_files(spark: SparkSession, sf: str) -> DataFrame:
    """service, category, host, file_name, size_bytes: one file per 64 events and directory."""
    return _rotated(spark, sf).select(
        "service", "category", "host",
        F.concat(F.lit("@"), "label", F.lit(".s")).alias("file_name"), "size_bytes",
    )


def usable_files(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.usable(rotated_files(spark, sf))


def _shipped(spark: SparkSession, sf: str) -> DataFrame:
    """What has been shipped so far: dir_date, name_date, service, host, taistamp.

    signup and (purchase, h3) never shipped; others lag by 0 to 2 days; (view, h0)
    files up to 2024-01-05 went out again in the newest directory.
    """
    day = F.to_date(F.timestamp_millis("ms"))
    lag = F.when(F.col("service") == "error", 2).when(F.col("service") == "click", 0).otherwise(1)
    again = (F.col("service") == "view") & (F.col("host") == "h0") & (day <= F.lit("2024-01-05"))
    files = _rotated(spark, sf).where(
        (F.col("service") != "signup")
        & ~((F.col("service") == "purchase") & (F.col("host") == "h3"))
        & (day <= F.date_sub(F.lit("2024-01-30").cast("date"), lag))
    )
    return files.select(
        F.when(again, F.lit("2024-01-31").cast("date")).otherwise(F.date_add(day, 1))
        .alias("dir_date"),
        day.alias("name_date"), "service", "host", F.col("label").alias("taistamp"),
    )


def archive_listing(spark: SparkSession, sf: str) -> DataFrame:
    """dir_date, file_name of everything shipped so far."""
    return _shipped(spark, sf).select(
        "dir_date",
        F.concat_ws(",", F.date_format("name_date", "yyyy,MM,dd"), "service", "host",
                    F.concat("taistamp", F.lit(".seq"))).alias("file_name"),
    )


def archive(spark: SparkSession, sf: str) -> DataFrame:
    """The parsed catalogue without the (view, h0) re-shipment case."""
    return _shipped(spark, sf).where(
        "NOT (service = 'view' AND host = 'h0' AND dir_date = '2024-01-31')"
    )


def spoiled_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The archive listing with every name whose label seconds end in 7 spoiled."""
    return archive_listing(spark, sf).withColumn(
        "file_name",
        F.when(F.substring("file_name", -13, 1) == "7", F.replace("file_name", F.lit(","),
                                                                  F.lit(";")))
        .otherwise(F.col("file_name")),
    )


def spoiled_files(spark: SparkSession, sf: str) -> DataFrame:
    """dir_name, file_name of the rotated files: ``error`` directories have no category, names whose seconds end in 7 no label."""
    dir_name = F.when(F.col("service") == "error", F.concat_ws("@", "service", "host")).otherwise(
        names.destination_key(F.col("service"), F.col("category"), F.col("host")))
    return rotated_files(spark, sf).select(
        dir_name.alias("dir_name"),
        F.when(F.substring("file_name", 17, 1) == "7", F.replace("file_name", F.lit("@"), F.lit("#")))
        .otherwise(F.col("file_name")).alias("file_name"))


def size_limit(files: DataFrame) -> int:
    """Mean bytes per directory, so that about half of them are above it."""
    per_dir = inventory.ready_bytes(files)
    return int(per_dir.agg(F.expr("sum(ready_bytes) div count(1)")).first()[0])


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """One document is one rotated file of ``source``/``lang``: adds dir keys and file_name."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("service"), F.col("lang").alias("category"),
        F.concat(F.lit("h"), (F.col("doc_id") % 4).cast("string")).alias("host"),
        F.concat(F.lit("@"), labels.encode_ms(F.col("doc_id") + F.lit(DOC_BASE_MS)), F.lit(".s"))
        .alias("file_name"),
        "doc_id", "text",
    )


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Inventory of the documents, sizes in bytes."""
    return inventory.usable(documents(spark, sf).select(
        "service", "category", "host", "file_name",
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    ))


def document_archive(spark: SparkSession, sf: str) -> DataFrame:
    """The first documents were shipped on 2024-01-30, per source and host."""
    first = documents(spark, sf).where(F.col("doc_id") < SHIPPED_DOCS)
    label = labels.label_of(F.col("file_name"))
    return first.groupBy("service", "host").agg(F.max(label).alias("taistamp")).select(
        F.lit("2024-01-30").cast("date").alias("dir_date"),
        F.to_date(labels.decode(F.col("taistamp"))).alias("name_date"),
        "service", "host", "taistamp",
    )


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """agent, side, file_name: what agents have and what the dry run asks for.

    Every 97th event adds a lock or a half written file to an agent's directory.
    """
    ev = events(spark, sf).select("event_id", F.col("host").alias("agent"), "ms")
    name = F.concat(F.lit("@"), labels.encode_ms(F.col("ms")), F.lit(".s"))
    junk = (
        F.when(F.col("event_id") % 194 == 0, F.concat(F.lit("lock"), F.lit("~")))
        .otherwise(F.concat(F.lit("@"), labels.encode_ms(F.col("ms")), F.lit(".u")))
    )
    local = ev.select("agent", F.lit("local").alias("side"), name.alias("file_name"), "event_id")
    extra = ev.where("event_id % 97 = 0").select("agent", F.lit("local").alias("side"),
                                                  junk.alias("file_name"), "event_id")
    last = F.col("event_id") >= F.col("_newest") - 40
    newest = ev.groupBy("agent").agg((F.max("event_id")).alias("_newest"))
    missing = local.join(newest, "agent").where((F.col("event_id") % 5 == 0) | last).select(
        "agent", F.lit("missing").alias("side"), "file_name", "event_id"
    )
    return local.unionByName(extra).unionByName(missing)


# Events of one millisecond have files of one name: what tells them apart is the event.
ATTEMPTED_FILE = ("file_name", "event_id")


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """agent, cycle, file_name, ok: every event is one attempted file; 200 events a cycle."""
    return events(spark, sf).select(
        F.col("host").alias("agent"), F.expr("event_id div 200").alias("cycle"),
        F.concat(F.lit("@"), labels.encode_ms(F.col("ms")), F.lit(".s")).alias("file_name"),
        (F.col("event_id") % 11 != 0).alias("ok"), "event_id",
    )


def after_listing(spark: SparkSession, sf: str) -> DataFrame:
    """agent, cycle, file_name, event_id: the directory after each cycle.

    Files of failed attempts are gone but for every 1001st, files of every 13th
    event were rotated away meanwhile.
    """
    kept = (F.col("ok") & (F.col("event_id") % 13 != 0)) | (F.col("event_id") % 1001 == 0)
    return attempts(spark, sf).where(kept).select("agent", "cycle", *ATTEMPTED_FILE)


TELEMETRY_KEYS = {
    "click": "files_to_ship",
    "error": "failed_to_get_sync_list",
    "view": "rotated_during_ship",
}
TELEMETRY_BASE_MS = 1_704_067_200_000
RECORDS_PER_HOUR = 9_600


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """ts, value, seq: 9,600 records in the first four minutes of each hour but the last.

    Every 101st value is not a number, every 103rd record is short.
    """
    kind = F.col("event_type")
    key = kind
    for event_type, metric in TELEMETRY_KEYS.items():
        key = F.when(kind == event_type, metric).otherwise(key)
    eid = F.col("event_id")
    ms = (
        F.lit(TELEMETRY_BASE_MS) + F.expr(f"event_id div {RECORDS_PER_HOUR}") * 3_600_000
        + (eid % 240) * 1000 + F.expr("event_id div 240") % 1000
    )
    amount = F.when(eid % 101 == 0, "many").otherwise((eid % 7).cast("string"))
    full = F.concat_ws(" ", F.lit("svc"), F.lit("main"), key, amount)
    return table(spark, sf, "events").select(
        F.timestamp_millis(ms).alias("ts"),
        F.when(eid % 103 == 0, "svc main").otherwise(full).alias("value"),
        eid.alias("seq"),
    )


def channel_events(spark: SparkSession, sf: str) -> DataFrame:
    """agent, ts, seq, kind: each event polls, clicks and views also beat."""
    ev = events(spark, sf)
    beat = F.col("event_type").isin("click", "view")
    kinds = F.when(beat, F.array(F.lit("poll"), F.lit("heartbeat"))).otherwise(
        F.array(F.lit("poll"))
    )
    return ev.select(
        F.col("host").alias("agent"), "ts", F.posexplode(kinds).alias("_i", "kind"), "event_id"
    ).select("agent", "ts", ((1_000_000_000 - F.col("event_id")) * 2 + F.col("_i")).alias("seq"), "kind")


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """service, host, line, event_id: one log line per event, every 50th blank."""
    line = F.concat_ws(" ", F.upper("event_type"), F.col("event_id").cast("string"),
                       F.col("props"))
    return events(spark, sf).select(
        F.lit("shop").alias("service"), "host",
        F.when(F.col("event_id") % 50 == 0, "").otherwise(line).alias("line"), "event_id",
    )


def idle_directories(spark: SparkSession, sf: str) -> DataFrame:
    """dir_name: an empty directory per customer nation and segment, some of names that are no service."""
    return table(spark, sf, "customer").select(
        F.concat(F.lit("_idle"), F.col("c_nationkey").cast("string"),
                 F.when(F.col("c_nationkey") % 7 == 0, "-").otherwise("@"),
                 F.lower("c_mktsegment"), F.lit("@h0")).alias("dir_name")).distinct()


def _folder_system(root: str):
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")


def _in_tasks(df: DataFrame, act) -> None:
    """Run ``act`` on each Arrow batch of ``df`` for what it does."""
    def run(batches):
        for batch in batches:
            act(batch)
            yield batch.slice(0, 0)

    df.mapInArrow(run, df.schema).write.format("noop").mode("overwrite").save()


def make_folders(dirs: DataFrame, root: str) -> None:
    """Create empty directories (dir_name), from the tasks."""
    def create(batch):
        system, base = _folder_system(root)
        for dir_name in batch.column(0).to_pylist():
            system.create_dir(f"{base}/{dir_name}", recursive=True)

    _in_tasks(dirs.select("dir_name"), create)


def dealt(names_: DataFrame) -> DataFrame:
    """Distinct (dir_name, file_name) rows over all tasks that a shuffle has.

    What comes out of an aggregate takes few bytes, and adaptive execution would leave millions of files to
    a task or two. A name that occurs often is one file and is written once.
    """
    tasks = int(names_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names_.select("dir_name", "file_name").distinct().repartition(tasks)


def put_files(df: DataFrame, root: str) -> None:
    """Write (dir_name, file_name, body) rows as files, from the tasks."""
    def write(batch):
        system, base = _folder_system(root)
        dirs, names_, bodies = batch.columns
        for dir_name in dirs.unique().to_pylist():
            system.create_dir(f"{base}/{dir_name}", recursive=True)
        for dir_name, file_name, body in zip(dirs.to_pylist(), names_.to_pylist(), bodies):
            with system.open_output_stream(f"{base}/{dir_name}/{file_name}") as out:
                out.write(body.as_buffer() or b"")

    _in_tasks(df.select("dir_name", "file_name", F.coalesce(F.col("body").cast("binary"), F.lit(b"")).alias("body")), write)


def document_spool(spark: SparkSession, sf: str, purpose: str = "spool") -> str:
    """The documents as real files below a fresh spool directory."""
    root = scratch_dir(spark, purpose)
    docs = documents(spark, sf).select(
        names.destination_key(F.col("service"), F.col("category"), F.col("host"))
        .alias("dir_name"),
        "file_name", F.col("text").alias("body"),
    )
    put_files(docs, root)
    return root
