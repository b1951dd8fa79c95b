"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scope = threading.local()


def use_utc(spark: SparkSession) -> SparkSession:
    """Labels, archive dates and directory dates are all UTC days."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only when the session names none (tests on one machine) is a temporary folder
    made and set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tideline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh, not yet existing path under the shared folder."""
    path = f"{ensure_checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch paths this thread takes within are removed at the end: nothing lazy may outlive it."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        for path in _scope.paths:
            delete_folder(spark, path)
        _scope.paths = outer


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, on whatever file system the pattern names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().toString() for status in (fs.globStatus(hadoop_path) or [])]


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as tasks need it, by the session's own default file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toString()


def delete_folder(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def read_folders(spark: SparkSession, root: str, column: str, wanted: Callable[[str], bool],
                 schema: str) -> DataFrame:
    """Parquet below ``root/<column>=<value>`` for the wanted values only.

    Other folders are not even listed, so a long history costs nothing.
    """
    paths = [
        path for path in matching_paths(spark, f"{root}/{column}=*")
        if wanted(path.rsplit("=", 1)[1])
    ]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*paths)
