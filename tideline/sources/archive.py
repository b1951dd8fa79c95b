"""SNK1-SNK3: the archive as committed batches, its catalogue and ledger.

Layout under the archive root:

    data/dir_date=<day>/publish_id=<id>/service=/host=/*.parquet   merged lines
    ledger/dir_date=<day>/publish_id=<id>/*.parquet                source files
    catalogue/dir_date=<day>/publish_id=<id>/*.parquet             archive files

A batch is published when its catalogue folder has its success marker; it is
written last and readers start from it, so a batch is visible whole or not at
all, and a second publish of the same id changes nothing. What is committed is
the pair of day and id: folders that a crash left under another day are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import names
from tideline.operators.inventory import KEYS
from tideline.operators.joins import settled
from tideline.session import matching_paths

# Files that one task removes at most, about.
FILES_A_TASK = 4096
CATALOGUE_SCHEMA = (
    "dir_date date, file_name string, service string, category string, host string, "
    "n_files bigint, bytes bigint, last_label string, publish_id string"
)
LINES_SCHEMA = (
    "category string, archive_name string, shard string, label string, block bigint, "
    "pos bigint, ship_ms bigint, line string, publish_id string, dir_date date, "
    "service string, host string"
)
LEDGER_SCHEMA = (
    "service string, category string, host string, file_name string, label string, "
    "archive_name string, publish_id string, dir_date date"
)
FILE_KEYS = ["service", "category", "host", "file_name"]
SNAPPY, DEFLATE = (
    "org.apache.hadoop.io.compress.SnappyCodec",
    "org.apache.hadoop.io.compress.DefaultCodec",
)


def committed(spark: SparkSession, root: str,
              days: Sequence[str] | None = None) -> list[tuple[str, str]]:
    """Day and id of the batches whose catalogue is complete: one pair per batch, not per file.

    ``days`` lists those days' folders only.
    """
    day = f"{{{','.join(days)}}}" if days else "*"
    found = matching_paths(spark, f"{root}/catalogue/dir_date={day}/publish_id=*/_SUCCESS")
    return sorted(tuple(part.split("=", 1)[1] for part in path.split("/")[-3:-1]) for path in found)


def committed_ids(spark: SparkSession, root: str, days: Sequence[str] | None = None) -> list[str]:
    """Ids of the committed batches."""
    return [publish_id for _, publish_id in committed(spark, root, days)]


def _committed(spark: SparkSession, root: str, table: str, schema: str,
               days: Sequence[str] | None = None) -> DataFrame:
    """A table's committed folders; others are neither listed nor read."""
    base = f"{root}/{table}"
    folders = [f"{base}/dir_date={day}/publish_id={publish_id}"
               for day, publish_id in committed(spark, root, days)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*folders)


def is_published(spark: SparkSession, root: str, publish_id: str) -> bool:
    pattern = f"{root}/catalogue/dir_date=*/publish_id={publish_id}/_SUCCESS"
    return bool(matching_paths(spark, pattern))


def publish(lines: DataFrame, units: DataFrame, source_files: DataFrame, root: str,
            publish_id: str, as_of: str, compression: str = "snappy") -> bool:
    """SNK1 + SNK2: write a batch of merged lines and commit it; False if it was.

    ``lines`` keep their task layout and order: each task writes its shards, and a
    hot unit is several files. The sort of the merge begins with the folder columns,
    so the writer adds none of its own. ``units`` and ``source_files`` must be settled
    tables, not plans over a directory that is still changing.
    """
    spark = lines.sparkSession
    if is_published(spark, root, publish_id):
        return False
    day = as_of[:10]
    (
        lines.write.mode("overwrite").option("compression", compression)
        .partitionBy("service", "host")
        .parquet(f"{root}/data/dir_date={day}/publish_id={publish_id}")
    )
    source_files.select(
        "service", "category", "host", "file_name", "label", "archive_name"
    ).write.mode("overwrite").parquet(f"{root}/ledger/dir_date={day}/publish_id={publish_id}")
    units.select(
        F.col("archive_name").alias("file_name"), "service", "category", "host",
        "n_files", "bytes", "last_label",
    ).write.mode("overwrite").parquet(
        f"{root}/catalogue/dir_date={day}/publish_id={publish_id}"
    )
    return True


def catalogue(spark: SparkSession, root: str, days: Sequence[str] | None = None) -> DataFrame:
    """Committed archive files; ``days`` prunes to the directories of a look-back."""
    return _committed(spark, root, "catalogue", CATALOGUE_SCHEMA, days)


def parsed_catalogue(spark: SparkSession, root: str,
                     days: Sequence[str] | None = None) -> DataFrame:
    """The catalogue in the shape the ship plan reads."""
    rows = catalogue(spark, root, days).select("dir_date", "file_name")
    return names.with_archive_fields(rows).where("name_ok").drop("name_ok")


def archived_lines(spark: SparkSession, root: str) -> DataFrame:
    """All committed lines; ``label, block, pos`` restores the order of a unit."""
    return _committed(spark, root, "data", LINES_SCHEMA)


def ledger(spark: SparkSession, root: str, days: Sequence[str] | None = None) -> DataFrame:
    """Every committed source file with the archive file that holds its lines."""
    return _committed(spark, root, "ledger", LEDGER_SCHEMA, days)


def ledger_marks(spark: SparkSession, root: str, days: Sequence[str] | None = None,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Greatest published label per key, whatever directory it went to.

    From the catalogue, one row per unit. It says where shipping stands, not which
    files were shipped; for that see :func:`unpublished`.
    """
    return catalogue(spark, root, days).groupBy(*keys).agg(
        F.max("last_label").alias("ledger_label")
    )


def unpublished(files: DataFrame, root: str, days: Sequence[str]) -> DataFrame:
    """STR7: the files, named by service, category, host and file name, that no batch has published.

    ``days`` back to the age limit are enough: a batch of a day before holds only
    files that are too old to ship now.
    """
    known = ledger(files.sparkSession, root, days).select(*FILE_KEYS).distinct()
    return files.join(known, FILE_KEYS, "left_anti")


def write_sequence_file(lines: DataFrame, path: str, codec: str = SNAPPY) -> None:
    """SNK1, compatible form: block-compressed (ship time in ms, line bytes) records.

    Keeps the row order and task layout of ``lines``. The Parquet form of
    :func:`publish` is the fast path; records pass through Python here.
    """
    pairs = lines.select("ship_ms", F.col("line").cast("binary").alias("line")).rdd.map(
        lambda r: (r[0], r[1])
    )
    conf = {
        "mapreduce.output.fileoutputformat.outputdir": path,
        "mapreduce.job.outputformat.class":
            "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat",
        "mapreduce.job.output.key.class": "org.apache.hadoop.io.LongWritable",
        "mapreduce.job.output.value.class": "org.apache.hadoop.io.BytesWritable",
        "mapreduce.output.fileoutputformat.compress": "true",
        "mapreduce.output.fileoutputformat.compress.type": "BLOCK",
        "mapreduce.output.fileoutputformat.compress.codec": codec,
    }
    pairs.saveAsNewAPIHadoopDataset(conf)


def read_sequence_file(spark: SparkSession, path: str) -> DataFrame:
    """Records of :func:`write_sequence_file`."""
    rows = spark.sparkContext.sequenceFile(
        path, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable"
    ).map(lambda kv: (kv[0], bytearray(kv[1])))
    return spark.createDataFrame(rows, "ship_ms bigint, bytes binary").select(
        "ship_ms", F.col("bytes").cast("string").alias("line")
    )


def delete_files(flagged: DataFrame, path: str = "path") -> None:
    """SNK3, opt-in: remove the files a retention manifest names, from the tasks.

    The names are written out first: a manifest over a listing could not be
    computed again once files are gone. Deleting a file twice is harmless, so a
    retried task is too.
    """
    def remove(batches):
        from pyarrow import fs

        systems = {}
        for batch in batches:
            for name in batch.column(0).to_pylist():
                scheme = name.split(":", 1)[0]
                local = name.removeprefix("file://").removeprefix("file:")
                if scheme == "file" or name.startswith("/"):
                    system, target = systems.setdefault("", fs.LocalFileSystem()), local
                else:
                    system, target = fs.FileSystem.from_uri(name)
                    system = systems.setdefault(scheme, system)
                if system.get_file_info(target).type != fs.FileType.NotFound:
                    system.delete_file(target)
            yield batch.slice(0, 0)

    doomed = settled(flagged.where("to_delete").select(F.col(path).alias("path")))
    # Names take few bytes, and so few partitions of the table, however many files there are.
    tasks = max(int(doomed.sparkSession.conf.get("spark.sql.shuffle.partitions")), doomed.count() // FILES_A_TASK)
    doomed.repartition(tasks).mapInArrow(remove, "path string").write.format("noop").mode("overwrite").save()
