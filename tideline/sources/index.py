"""STR1: an inventory of the spool that is kept between rounds and only changed where the spool did.

    dirs/batch_id=<n>/     one row per directory there is: state, and the batch that listed it
    files/batch_id=<n>/    the files of the directories that batch listed

A round walks the root (one row per directory), lists the directories whose time of change is new,
and takes the others' state from the round before. What a directory held when it was
last listed are its rows in that batch's folder, so a file or directory that has gone is gone from
the index without a delete. Folders are overwritten by a replay of their batch; when the live rows
are spread over many of them they are written together once, and what two rounds no
longer need is removed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import names, predicates
from tideline.operators import inventory
from tideline.operators.inventory import DIR_KEYS
from tideline.operators.joins import join_keyed, settled
from tideline.session import delete_folder, matching_paths, read_folders
from tideline.sources import walk

DIRS_SCHEMA = (
    "dir_name string, path string, changed_us bigint, seen_us bigint, listed_in bigint, error string, "
    "ready_bytes bigint, n_files bigint, n_bad_names bigint, first_label string, last_label string"
)
FILES_SCHEMA = "dir_name string, file_name string, size_bytes bigint, path string, label string, batch_id bigint"
# A directory that changed so shortly before it was listed may change again within the same tick of
# the file system's clock, or by a clock that is behind; it is listed once more.
MARGIN_US = 5_000_000
# Folders with live rows from which they are written together.
COMPACT_AFTER = 16


@dataclass
class Index:
    """The spool as of one batch: ``dirs`` by DIRS_SCHEMA, ``fresh`` the files no earlier batch had."""

    spark: SparkSession
    root: str
    dirs: DataFrame
    fresh: DataFrame
    listed: int

    def files(self, only: DataFrame | None = None) -> DataFrame:
        """Files of all directories or of those in ``only`` (``dir_name``), with identity; bad names have no label."""
        dirs = self.dirs if only is None else self.dirs.join(only, "dir_name", "left_semi")
        return names.with_service_identity(_live(self.spark, self.root, dirs))

    def state(self) -> DataFrame:
        """AGG1 + AGG3 + W4 per service directory with a usable file, without reading a file row."""
        rows = names.with_service_identity(self.dirs).where("dir_ok AND n_files > 0")
        return rows.select(*DIR_KEYS, "dir_name", "ready_bytes", "n_files", "first_label", "last_label")


def _batches(spark: SparkSession, root: str, table: str) -> list[int]:
    found = matching_paths(spark, f"{root}/{table}/batch_id=*/_SUCCESS")
    return sorted(int(path.split("/")[-2].split("=", 1)[1]) for path in found)


def _dirs(spark: SparkSession, root: str, batch_id: int | None) -> DataFrame:
    if batch_id is None:
        return spark.createDataFrame([], DIRS_SCHEMA)
    return spark.read.schema(DIRS_SCHEMA).parquet(f"{root}/dirs/batch_id={batch_id}")


def _folders(dirs: DataFrame) -> list[int]:
    """The batches that hold rows of these directories: at most COMPACT_AFTER and one."""
    return sorted(r[0] for r in dirs.where("listed_in IS NOT NULL").select("listed_in").distinct().collect())


def _live(spark: SparkSession, root: str, dirs: DataFrame) -> DataFrame:
    """File rows of ``dirs``, each from the batch that listed its directory last."""
    folders = set(map(str, _folders(dirs)))
    rows = read_folders(spark, f"{root}/files", "batch_id", folders.__contains__, FILES_SCHEMA)
    owned = dirs.select("dir_name", F.col("listed_in").alias("batch_id"))
    return join_keyed(rows, owned, ["dir_name", "batch_id"], "inner").drop("batch_id")


def advance(spark: SparkSession, spool: str | list[str], root: str, batch_id: int,
            exclude: Sequence[str] = predicates.HIDDEN_FILES, margin_us: int = MARGIN_US,
            compact_after: int = COMPACT_AFTER) -> Index:
    """Bring the index at ``root`` up to the spool as it is now, as batch ``batch_id``.

    Sizes are those of the listing: rotated files do not grow. A directory that can't be listed
    keeps its ``error``, no files, and is tried again by the next batch.
    """
    earlier = [b for b in _batches(spark, root, "dirs") if b < batch_id]
    before = _dirs(spark, root, earlier[-1] if earlier else None)
    now = settled(walk.directories(spark, spool))
    both = now.join(before.withColumnsRenamed({"path": "_path", "changed_us": "_changed", "seen_us": "_seen"}),
                    "dir_name", "left")
    same = (
        (F.col("_changed") == F.col("changed_us")) & (F.col("_path") == F.col("path"))
        & (F.col("_changed") < F.col("_seen") - margin_us) & F.col("error").isNull()
    )
    marked = settled(both.withColumn("same", F.coalesce(same, F.lit(False))))
    columns = [c.split()[0] for c in DIRS_SCHEMA.split(", ")]
    # The state of an unchanged directory stands, with the time at which it was listed.
    kept = marked.where("same").withColumn("seen_us", F.col("_seen")).select(*columns)
    changed = marked.where("NOT same")
    listed = walk.entries(changed)
    rows = inventory.enrich(listed.where(
        F.col("error").isNotNull() | ~predicates.excluded(F.col("file_name"), exclude)))
    rows = settled(rows.select("dir_name", "file_name", "size_bytes", "path", "label", "error"))
    held = rows.where("error IS NULL").drop("error")
    moved = len(_folders(kept)) >= compact_after
    whole = held.unionByName(_live(spark, root, kept).select(*held.columns)) if moved else held
    whole.write.mode("overwrite").parquet(f"{root}/files/batch_id={batch_id}")
    sums = rows.groupBy("dir_name").agg(
        F.max("error").alias("error"),
        F.sum(F.when(F.col("label").isNotNull(), F.col("size_bytes"))).alias("ready_bytes"),
        F.count("label").alias("n_files"),
        F.count_if(F.col("label").isNull() & F.col("error").isNull()).alias("n_bad_names"),
        F.min("label").alias("first_label"), F.max("label").alias("last_label"),
    )
    anew = changed.select("dir_name", "path", "changed_us", "seen_us", F.lit(batch_id).cast("bigint").alias("listed_in")).join(
        sums, "dir_name", "left").na.fill(0, ["ready_bytes", "n_files", "n_bad_names"])
    if moved:
        kept = kept.withColumn("listed_in", F.lit(batch_id).cast("bigint"))
    anew.select(*columns).unionByName(kept).write.mode("overwrite").parquet(f"{root}/dirs/batch_id={batch_id}")
    # Fresh: files of the listed directories that their last listing did not have.
    fresh = names.with_service_identity(held)
    if earlier:
        known = before.join(changed.select("dir_name"), "dir_name", "left_semi")
        fresh = settled(fresh.join(_live(spark, root, known).select("dir_name", "file_name"),
                                   ["dir_name", "file_name"], "left_anti"))
    _forget(spark, root, earlier, batch_id)
    return Index(spark, root, _dirs(spark, root, batch_id), fresh, changed.count())


def _forget(spark: SparkSession, root: str, earlier: list[int], batch_id: int) -> None:
    """Remove folders that neither this batch nor the one before it reads, whose replay may still come."""
    for old in earlier[:-1]:
        delete_folder(spark, f"{root}/dirs/batch_id={old}")
    last = earlier[-1:] + [batch_id]
    needed = set().union(*(_folders(_dirs(spark, root, b)) for b in last), last)
    for old in _batches(spark, root, "files"):
        if old < batch_id and old not in needed:
            delete_folder(spark, f"{root}/files/batch_id={old}")
