"""SRC4 inside tasks: lines of byte ranges of files.

Lines end with LF, CR or CRLF. A range has the lines that begin behind its first byte and
not behind its end; the first range also has the one at byte 0. So each line of a file is in one
range, wherever the cuts lie, and a task reads no more than the rest of its last line beyond its range.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from tideline.operators.inventory import DIR_KEYS

LINES = "service string, category string, host string, file_name string, block bigint, pos bigint, line string"
# Bytes read at a time, and rows handed on at a time.
BLOCK = 4 << 20
ROWS = 16_384
BOM = b"\xef\xbb\xbf"
PACKED = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}


def packed(file_name: Column) -> Column:
    """Compressed files, which are unpacked from their start."""
    return file_name.rlike(rf"\.({'|'.join(PACKED)})$")


def _open(path: str, start: int):
    """A file at ``start``, for reading on."""
    from pyarrow import fs

    codec = PACKED.get(path.rsplit(".", 1)[-1])
    if path.startswith("file:"):
        local = "/" + path.removeprefix("file:").lstrip("/")
        if codec is None:
            source = open(local, "rb", buffering=0)
            source.seek(start)
            return source
        system, base = fs.LocalFileSystem(), local
    else:
        head = path.split("/", 3)
        system, base = fs.FileSystem.from_uri("/".join(head[:3]) + "/")
        base = f"{base.rstrip('/')}/{head[3]}"
    if codec:
        return system.open_input_stream(base, compression=codec)
    source = system.open_input_file(base)
    source.seek(start)
    return source


def lines_from(source, start: int, end: int | None) -> Iterator[list[bytes]]:
    """Lines of one range of ``source``, which stands at ``start``; without ``end`` to the end of the file."""
    at, rest, skip = start, b"", start > 0
    while True:
        block = source.read(BLOCK)
        data = rest + block
        # A CR at the end may be half of a CRLF.
        cut = max(data.rfind(b"\n"), data.rfind(b"\r", 0, max(len(data) - 1, 0))) + 1 if block else len(data)
        whole, rest = data[:cut], data[cut:]
        over = end is not None and at + cut > end
        if over or skip:
            lines = whole.splitlines(keepends=True)
            begins = accumulate(map(len, lines), initial=at)
            kept = [x for x, begin in zip(lines, begins) if end is None or begin <= end]
            if skip and lines:
                kept, skip = kept[1:], False
            found = [x for y in kept for x in y.splitlines()]
        else:
            found = whole.splitlines()
        if at == 0 and found and found[0].startswith(BOM):
            found = [found[0][len(BOM):], *found[1:]] if whole != BOM else []
        if found:
            yield found
        if over or not block:
            return
        at += cut


def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LINES of ranges given as directory keys, ``file_name``, ``path``, ``block``, ``end``."""
    schema = pa.schema([*((c, pa.string()) for c in (*DIR_KEYS, "file_name")),
                        ("block", pa.int64()), ("pos", pa.int64()), ("line", pa.string())])

    def handed_on(lines: list[bytes], runs: list[tuple]) -> pa.RecordBatch:
        *keys, block, first, length = zip(*runs)
        which = pa.array(np.repeat(np.arange(len(runs)), length))
        pos = np.concatenate([np.arange(f, f + n) for f, n in zip(first, length)])
        # Bytes stay as they are, valid or not.
        return pa.RecordBatch.from_arrays(
            [*(pa.array(k, pa.string()).take(which) for k in keys), pa.array(block, pa.int64()).take(which),
             pa.array(pos, pa.int64()), pa.array(lines, pa.binary()).view(pa.string())], schema=schema)

    lines, runs, held = [], [], 0
    for batch in batches:
        for *keys, path, block, end in zip(*(c.to_pylist() for c in batch.columns)):
            pos = 0
            try:
                with _open(path, block) as source:
                    for found in lines_from(source, block, end):
                        for i in range(0, len(found), ROWS):
                            part = found[i:i + ROWS]
                            lines += part
                            runs.append((*keys, block, pos, len(part)))
                            pos, held = pos + len(part), held + sum(map(len, part))
                            if len(lines) >= ROWS or held >= BLOCK:
                                yield handed_on(lines, runs)
                                lines, runs, held = [], [], 0
            except FileNotFoundError:
                continue
    if runs:
        yield handed_on(lines, runs)
