"""Token ids in files of patched frame-of-reference blocks.

A file holds segments, each followed by one line feed. A segment, little-endian:

    head   magic "TPFR", u32 bytes of the segment, u32 shard, u32 number in the shard,
           u32 documents, u32 blocks, u64 ids
    docs   i64 document id of each, u8 1 if that id is null, u32 ids of each
    index  u32 start of each block from the segment's begin
    blocks u32 minimum, u8 width, u8 exceptions, 2 * width u64 of packed differences,
           u8 position and u32 difference of each exception

A block has 128 ids; the last one is filled up with its minimum. Its width holds a set share of
its differences; larger ones are exceptions. Any block can be read by itself.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import tokens
from tideline.llm.common import fanout, running_total, settled
from tideline.operators.joins import join_keyed

BLOCK = 128
HEAD = struct.Struct("<4sIIIIIQ")
MAGIC = b"TPFR"
#: Ids after which a segment ends, and segments in a file: a file has a few tens of MB.
SEGMENT_IDS, FILE_SEGMENTS = 1 << 20, 8


def _bits(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(float))).astype(np.int64) + 1, 0)


def pack_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks of ``ids`` (u32) in the bytes returned with them."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.int64), b""
    grid = np.full(n * BLOCK, ids[-1], np.uint64)
    grid[:len(ids)] = ids
    grid = grid.reshape(n, BLOCK)
    if len(ids) % BLOCK:
        grid[-1, len(ids) % BLOCK:] = grid[-1, :len(ids) % BLOCK].min()
    low = grid.min(1)
    grid -= low[:, None]
    width = _bits(np.partition(grid, int(percentile * BLOCK) - 1, axis=1)[:, int(percentile * BLOCK) - 1])
    odd = (grid >> width.astype(np.uint64)[:, None]) > 0
    count = odd.sum(1)
    size = 6 + 16 * width + 5 * count
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[start + 4], out[start + 5] = width, count
    plain = np.where(odd, 0, grid)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            lanes, packed = np.ascontiguousarray(plain[mine].T), np.zeros((2 * int(w), len(mine)), np.uint64)
            for j in range(BLOCK):
                lane, shift = divmod(j * int(w), 64)
                packed[lane] |= lanes[j] << np.uint64(shift)
                if shift + w > 64:
                    packed[lane + 1] |= lanes[j] >> np.uint64(64 - shift)
            out[start[mine][:, None] + 6 + np.arange(16 * int(w))] = (
                np.ascontiguousarray(packed.T).astype("<u8").view(np.uint8).reshape(len(mine), -1))
    row, position = np.nonzero(odd)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    behind = start + 6 + 16 * width
    out[behind[row] + nth] = position
    out[(behind[row] + count[row] + 4 * nth)[:, None] + np.arange(4)] = (
        grid[row, position].astype("<u4").view(np.uint8).reshape(-1, 4))
    return start, out.tobytes()


def unpack_blocks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``start`` in ``data`` (u8), 128 for each."""
    n = len(start)
    grid = np.zeros((n, BLOCK), np.uint64)
    if not n:
        return grid.astype("<u4").ravel()
    low = np.ascontiguousarray(data[start[:, None] + np.arange(4)]).view("<u4").ravel()
    width, count = data[start + 4].astype(np.int64), data[start + 5].astype(np.int64)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            packed = np.ascontiguousarray(
                data[start[mine][:, None] + 6 + np.arange(16 * int(w))]).view("<u8").T
            packed, mask = np.ascontiguousarray(packed), np.uint64((1 << int(w)) - 1)
            lanes = np.empty((BLOCK, len(mine)), np.uint64)
            for j in range(BLOCK):
                lane, shift = divmod(j * int(w), 64)
                lanes[j] = packed[lane] >> np.uint64(shift)
                if shift + w > 64:
                    lanes[j] |= packed[lane + 1] << np.uint64(64 - shift)
                lanes[j] &= mask
            grid[mine] = lanes.T
    row = np.repeat(np.arange(n), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    behind = start + 6 + 16 * width
    values = np.ascontiguousarray(
        data[(behind[row] + count[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    grid[row, data[behind[row] + nth]] = values
    return (grid + low[:, None].astype(np.uint64)).astype("<u4").ravel()


def encode_segment(shard: int, number: int, docs: list[int | None], ids: list[np.ndarray]) -> bytes:
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    start, blocks = pack_blocks(every)
    first = HEAD.size + 13 * len(docs) + 4 * len(start)
    return b"".join([
        HEAD.pack(MAGIC, first + len(blocks), shard, number, len(docs), len(start), len(every)),
        np.array([d or 0 for d in docs], "<i8").tobytes(),
        np.array([d is None for d in docs], np.uint8).tobytes(),
        np.array([len(x) for x in ids], "<u4").tobytes(), (start + first).astype("<u4").tobytes(), blocks])


def segments(content: bytes | pa.Buffer) -> Iterator[tuple[tuple, memoryview]]:
    """Heads and bytes of a file's segments."""
    at, view = 0, memoryview(content)
    while at < len(content):
        head = HEAD.unpack_from(view, at)
        if head[0] != MAGIC:
            raise ValueError("not a segment")
        yield head, view[at:at + head[1]]
        at += head[1] + 1


def segment_docs(head: tuple, data: memoryview) -> tuple[list[int | None], np.ndarray]:
    n, at = head[4], HEAD.size
    ids = np.frombuffer(data, "<i8", n, at)
    null = np.frombuffer(data, np.uint8, n, at + 8 * n)
    return [None if z else int(d) for d, z in zip(ids, null)], np.frombuffer(data, "<u4", n, at + 9 * n)


def segment_ids(head: tuple, data: memoryview, low: int = 0, high: int | None = None) -> np.ndarray:
    """Ids ``low`` to ``high`` of a segment; only their blocks are unpacked."""
    high = head[6] if high is None else min(high, head[6])
    if high <= low:
        return np.zeros(0, "<u4")
    start = np.frombuffer(data, "<u4", head[5], HEAD.size + 13 * head[4]).astype(np.int64)
    some = start[low // BLOCK:-(-high // BLOCK)]
    return unpack_blocks(np.frombuffer(data, np.uint8), some)[low % BLOCK:low % BLOCK + high - low]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Write the ids of all texts under ``path``: files in ``data``, where segments begin in ``index``.

    Takes ``doc_id`` and ``text`` (null is empty); other columns are left out. Documents come in
    ascending order of id (null first), repeated ids in order of their text. Tasks write their
    own id range through Spark's committed text writer, whose rows are segments, so a lost
    executor leaves no half-written file.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        tail, encoder = np.array([end_id], "<u4").tobytes(), tokens.encoder(vocabulary)

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([encode_segment(shard, number, held, ids)], pa.binary())], names=["segment"])

        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                for doc, data in zip(batch.column(0).to_pylist(), encoder(batch.column(1).to_pylist())):
                    held.append(doc)
                    ids.append(np.frombuffer(data + tail, "<u4"))
                    size += len(ids[-1])
                    if size >= SEGMENT_IDS:
                        yield full()
                        number, held, ids, size = number + 1, [], [], 0
        if held:
            yield full()
        encoder.forget()

    spark = docs.sparkSession
    ordered = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
               .repartitionByRange(fanout(spark), "doc_id").sortWithinPartitions("doc_id", "text"))
    (ordered.mapInArrow(encode, "segment binary").select(F.col("segment").cast("string"))
     .write.option("maxRecordsPerFile", FILE_SEGMENTS).text(f"{path}/data"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h[2], h[3], h[4], h[6]) for c in batch.column(0) for h, _ in segments(c.as_buffer())]
            for some in [found] if found else []:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*some)], names=["shard", "number", "docs", "ids"])

    # Written, as ordering would read all files twice.
    listed = settled(files(spark, path).mapInArrow(heads, "shard long, number long, docs long, ids long"))
    running_total(listed, ["shard", "number"], "ids", "start").write.parquet(f"{path}/index")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/data").select("content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write` wrote: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids``."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for head, data in segments(content.as_buffer()):
                    docs, sizes = segment_docs(head, data)
                    raw, ends = segment_ids(head, data).tobytes(), np.cumsum(sizes.astype(np.int64))
                    begins, n = ends - sizes, len(docs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, head[2], np.int64)), pa.array(np.full(n, head[3], np.int64)),
                         pa.array(docs, pa.int64()), pa.array(begins), pa.array(sizes.astype(np.int64)),
                         pa.array([raw[4 * a:4 * b] for a, b in zip(begins, ends)], pa.binary())],
                        names=["shard", "number", "doc_id", "within", "n_tokens", "ids"])

    rows = files(spark, path).mapInArrow(
        decode, "shard long, number long, doc_id long, within long, n_tokens long, ids binary")
    index = spark.read.parquet(f"{path}/index").select("shard", "number", "start")
    return join_keyed(rows, index, ["shard", "number"], "inner").select(
        "doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids")
