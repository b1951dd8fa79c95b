"""SRC1 / SRC2: the spool's directories and files, walked in tasks.

One task lists a root, which gives one row per directory; the directories are then dealt over the
cluster, and each task lists its own. The driver sees no name. Empty files and empty
directories are found like any other, whatever their names begin with.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tideline.session import qualified

# Entries handed on at a time: a directory may hold any number.
BATCH = 8192
DIRECTORIES = "dir_name string, path string, changed_us bigint, seen_us bigint"
ENTRIES = "dir_name string, file_name string, size_bytes bigint, path string, error string"


def _entries(path: str) -> Iterator[tuple[str, bool, int, int]]:
    """Name, whether a directory, bytes and time of change (us) of what a folder holds; what vanishes meanwhile is left out."""
    from pyarrow import fs

    if path.startswith("file:"):
        local = "/" + path.removeprefix("file:").lstrip("/")
        with os.scandir(local) as found:
            for entry in found:
                try:
                    stat = entry.stat()
                    yield entry.name, entry.is_dir(), stat.st_size, stat.st_mtime_ns // 1000
                except FileNotFoundError:
                    continue
        return
    head = path.split("/", 3)
    system, base = fs.FileSystem.from_uri("/".join(head[:3]) + "/")
    for info in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{head[3]}")):
        yield info.base_name, info.type == fs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1000


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def directories(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """SRC2: ``dir_name``, ``path``, ``changed_us`` and ``seen_us`` of each directory of each root.

    ``changed_us`` is when a name was last added or removed, by the file system's clock;
    ``seen_us`` the listing task's clock. A root that is not there is an error.
    """
    roots = [root] if isinstance(root, str) else list(root)
    schema = pa.schema([("dir_name", pa.string()), ("path", pa.string()), ("changed_us", pa.int64()), ("seen_us", pa.int64())])

    def below(batches):
        def rows():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    for name, is_dir, _, changed in _entries(path):
                        if is_dir:
                            yield name, f"{path}/{name}", changed, time.time_ns() // 1000
        return _batches(rows(), schema)

    start = spark.createDataFrame([(qualified(spark, r),) for r in roots], "path string")
    return start.mapInArrow(below, DIRECTORIES)


def entries(dirs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Files in ``dirs`` (``dir_name``, ``path``), not in folders below them.

    ``dir_name, file_name, size_bytes, path, error``. A directory that can't be listed is one row
    with ``error`` and no file; one that has gone since is no row.
    """
    schema = pa.schema([("dir_name", pa.string()), ("file_name", pa.string()), ("size_bytes", pa.int64()),
                        ("path", pa.string()), ("error", pa.string())])

    def inside(batches):
        def rows():
            for batch in batches:
                for dir_name, path in zip(*(c.to_pylist() for c in batch.columns)):
                    try:
                        for name, is_dir, size, _ in _entries(path):
                            if not is_dir:
                                yield dir_name, name, size, f"{path}/{name}", None
                    except FileNotFoundError:
                        continue
                    except OSError as e:
                        yield dir_name, None, None, path, f"{type(e).__name__}: {e.strerror or e}"
        return _batches(rows(), schema)

    n = tasks or int(dirs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dirs.select("dir_name", "path").repartition(n).mapInArrow(inside, ENTRIES)
