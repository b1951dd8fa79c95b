"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one of each group kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import components, fanout, settled, small_batches
from tideline.llm.vectors import matrix, unit, unusable, usable


def fit_cells(sample: DataFrame, cells: int, rounds: int) -> np.ndarray:
    """Unit centres of a spherical k-means over ``sample`` (``id``, ``embedding``), summed in tasks."""
    start = sample.orderBy(F.xxhash64("embedding", F.lit("centre")), "id").limit(cells)
    centres = unit(np.array([r["embedding"] for r in start.select("embedding").collect()], float))
    for _ in range(rounds):
        def add(batches, centres=centres):
            sums, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                x = unit(matrix(batch.column(0)))
                if len(x):
                    cell = np.argmax(x @ centres.T, axis=1)
                    np.add.at(sums, cell, x)
                    counts += np.bincount(cell, minlength=len(centres))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["cell", "sums"])

        parts = sample.select("embedding").mapInArrow(add, "cell long, sums array<double>")
        whole = parts.select("cell", F.posexplode("sums")).groupBy("cell", "pos").agg(F.sum("col").alias("s"))
        moved = np.zeros_like(centres)
        for r in whole.collect():  # cells x dimensions, whatever the number of vectors
            moved[r["cell"], r["pos"]] = r["s"]
        full = np.abs(moved).max(1) > 0
        centres[full] = unit(moved[full])
    return centres


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node connected with each of ``n`` nodes by links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(x: np.ndarray, y: np.ndarray, least: float, same: bool):
    """Pairs of rows of ``x`` and ``y`` whose cosine is at least ``least``, some rows at a time; ``same``: each pair once.

    Single precision decides wherever its error can't matter, double precision elsewhere.
    """
    margin = (x.shape[1] + 2) * 2.0 ** -23
    fx, fy = x.astype(np.float32), y.astype(np.float32)
    step = max(1, (1 << 21) // max(len(y), 1))
    for i in range(0, len(x), step):
        near = fx[i:i + step] @ fy.T
        a, b = np.nonzero(near >= least - margin)
        near = near[a, b]
        a = a + i
        if same:
            once = a < b
            a, b, near = a[once], b[once], near[once]
        doubt = np.flatnonzero(near < least + margin)
        keep = np.ones(len(a), bool)
        for j in range(0, len(doubt), 1 << 16):
            d = doubt[j:j + (1 << 16)]
            keep[d] = (x[a[d]] * y[b[d]]).sum(1) >= least
        yield a[keep], b[keep]


def _comparer(least: float, dim: int, kind: str, centres: np.ndarray):
    """Compares two blocks: links of each vector, and links that connect them."""
    def opened(row: dict, side: str):
        ids, copies, cells = (np.frombuffer(row[side + name].as_buffer(), np.int64) for name in ("ids", "copies", "own"))
        return ids, copies, cells, unit(np.frombuffer(row[side + "x"].as_buffer(), kind).reshape(-1, dim).astype(float))

    def compare(row: dict) -> pa.RecordBatch:
        same = row["a_block"].as_py() == row["b_block"].as_py()
        (ids, copies, own, x), (ids_b, copies_b, own_b, y) = opened(row, "a_"), opened(row, "b_")
        n = len(ids)
        links, label = np.zeros(n + len(ids_b)), np.arange(n + len(ids_b))
        there, first = np.unique(own_b, return_index=True)  # a block's vectors come by cell
        met = visits(x, own, centres, there, least)
        most = met.mean(0) > 0.5
        ends = np.append(first[1:], len(ids_b))
        parts = [(np.arange(n), np.flatnonzero(most[np.searchsorted(there, own_b)]))] if most.any() and not same else []
        if same:  # one triangle: what lies beyond no vector's reach is seen once, as all is
            parts = [(np.arange(n), np.arange(n))]
        else:
            parts += [(np.flatnonzero(met[:, c]), np.arange(first[c], ends[c])) for c in np.flatnonzero(~most & met.any(0))]
        for left, right in parts:
            for a, b in _links(x[left], y[right], least, same):
                a, b = left[a], right[b]
                links += np.bincount(a, copies_b[b], len(links)) + np.bincount(n + b, copies[a], len(links))
                one, other = label[a], label[b if same else n + b]
                if (far := one != other).any():
                    label = _forest(one[far], other[far], len(label))[label]
        ids = np.append(ids, ids_b)
        if same:
            links, label, ids = links[:n] + links[n:], label[:n], ids[:n]
        counted, linked = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([
            pa.array(np.r_[ids[counted], ids[linked]]),
            pa.array(np.r_[links[counted].astype(np.int64), np.zeros(len(linked), np.int64)]),
            pa.array(np.r_[np.zeros(len(counted), np.int64), ids[label[linked]]],
                     mask=np.r_[np.ones(len(counted), bool), np.zeros(len(linked), bool)])], names=["id", "links", "to"])

    def all_pairs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield compare({name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)})

    return all_pairs


def homes(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Home cell of each unit vector, the one of the nearest centre."""
    return np.argmax(x @ centres.T, axis=1) if len(x) else np.zeros(0, int)


def visits(x: np.ndarray, home: np.ndarray, centres: np.ndarray, cells: np.ndarray, least: float) -> np.ndarray:
    """In which of ``cells`` (vectors x cells) a unit vector of cell ``home`` can have links.

    The plane midway between two centres parts their homes, so the cosine of a vector with any home
    beyond it is at most that with the plane. A vector is left out of the cells where that is below
    ``least``, and of no others.
    """
    there = centres[cells]
    span = np.sqrt(np.maximum(2 - 2 * (centres @ there.T)[home], 0))
    apart = (x * centres[home]).sum(1)[:, None] - x @ there.T
    reach = np.sqrt(1 - max(least, 0.0) ** 2) + 1e-9
    return (apart <= reach * span + 1e-9) | (home[:, None] == cells)


def arranged(centres: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First block of each cell and over how many blocks it is dealt: near cells share one of about ``size`` vectors."""
    start, parts = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
    open_, at = [np.arange(len(centres))], 0
    while open_:
        cells = open_.pop()
        total = counts[cells].sum()
        if len(cells) > 1 and total > size:
            x = centres[cells] - centres[cells].mean(0)
            axis = np.ones(x.shape[1])
            for _ in range(8):
                axis = x.T @ (x @ axis)
                axis = axis / (np.sqrt((axis * axis).sum()) or 1.0)
            cells = cells[np.argsort(x @ axis, kind="stable")]
            half = min(max(int(np.searchsorted(np.cumsum(counts[cells]), total / 2)), 1), len(cells) - 1)
            open_ += [cells[half:], cells[:half]]
        else:
            start[cells], parts[cells] = at, max(1, -(-total // size))
            at += parts[cells[0]]
    return start, parts


def digest(vector):
    """Where a vector is looked up; different vectors may share one."""
    return F.xxhash64(vector)


def dedup(vectors: DataFrame, least: float = 0.9, cell_size: int = 1_000, most_cells: int = 4_096,
          rounds: int = 6, sample: int = 100_000, block: int = 1_024) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row.

    Takes ``vec_id`` and ``embedding``; other columns are left out. Vectors link when their cosine, in
    double precision, is at least ``least``. Equal vectors are compared once and counted as
    often as they are. The centres are fitted on at most about ``sample`` vectors; all vectors get a
    home cell, and near cells are written together, as blocks of ``block`` to eight times as many vectors.
    Tasks read pairs of blocks where they lie (no vector is copied for another) and compare each vector with the
    cells whose homes may be near enough (:func:`visits`).
    All pairs are found, whatever the cells. Null vectors, zero ones and those with
    null or non-finite components link with nothing; vectors link only with those of their own
    length. Rows without an id are kept, alone. An id on several rows stands for each of them by
    itself: every row has the links and component of its own vector, ``component_id`` is the least
    id of a row in it, and all rows with that id in it are kept. Empty tables give no row.
    """
    spark = vectors.sparkSession
    narrow = dict(vectors.dtypes)["embedding"] == "array<float>"  # exact and half as long
    width, kind = (4, "<f4") if narrow else (8, "<f8")
    number = "float" if narrow else "double"
    plain = F.transform("embedding", lambda v: F.when(v == 0, 0.0).otherwise(v).cast(number))  # no -0.0
    rows = settled(usable(vectors).select("vec_id", plain.alias("embedding")))
    # Ids may be on several vectors, so a distinct vector's number is its own; it is written once.
    distinct = settled(rows.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
                       .withColumn("id", F.monotonically_increasing_id()))
    counts, edges = [], []
    for dim, n in [(r["d"], r["n"]) for r in distinct.groupBy(F.size("embedding").alias("d")).agg(
            F.count("*").alias("n")).collect()]:
        mine = distinct.where(F.size("embedding") == dim)
        grain = 1 << 20
        fitted = settled(mine.where(F.pmod(F.xxhash64("embedding"), F.lit(grain)) < grain * min(1.0, sample / n))
                         .withColumn("embedding", F.col("embedding").cast("array<double>")))
        centres = fit_cells(fitted, int(min(most_cells, max(1, n // cell_size))), rounds)

        def units(batches):
            for whole in batches:
                for batch in (whole.slice(i, 1_024) for i in range(0, whole.num_rows, 1_024)):
                    raw = matrix(batch.column(1))
                    yield batch, raw, unit(raw.astype(float))

        def count(batches, centres=centres):
            sums = np.zeros(len(centres), np.int64)
            for _, _, x in units(batches):
                sums += np.bincount(homes(x, centres), minlength=len(centres))
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["cell", "n"])

        inside = np.zeros(len(centres), np.int64)
        for r in mine.select("id", "embedding").mapInArrow(count, "cell long, n long").groupBy("cell").agg(
                F.sum("n").alias("n")).collect():  # a row for each cell
            inside[r["cell"]] = r["n"]
        # So many files that their pairs keep all tasks busy, of at most about 16 MB.
        files = max(int(np.ceil(2 * np.sqrt(fanout(spark)))), -(-n * dim * width // (16 << 20)))
        start, parts = arranged(centres, inside, min(8 * block, max(block, n // (4 * files))))

        def assign(batches, centres=centres, start=start, parts=parts):
            for batch, raw, x in units(batches):
                home, ids = homes(x, centres), batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(start[home] + ids % parts[home]), batch.column(0), batch.column(2), pa.array(home),
                     pa.array([r.tobytes() for r in raw], pa.binary())], names=["block", "id", "copies", "own", "x"])

        def pack(t):
            t = t.take(np.argsort(t.column("own").to_numpy(), kind="stable"))
            own, raw = t.column("own").to_numpy(), b"".join(t.column("x").to_pylist())
            x, met = unit(np.frombuffer(raw, kind).reshape(-1, dim).astype(float)), np.zeros(len(centres), bool)
            for i in range(0, len(x), 1_024):
                met |= visits(x[i:i + 1_024], own[i:i + 1_024], centres, np.arange(len(centres)), least).any(0)
            return pa.table({"block": t.column("block").slice(0, 1), "cells": pa.array([np.unique(own)], pa.list_(pa.int64())),
                             "met": pa.array([np.flatnonzero(met)], pa.list_(pa.int64())),
                             "ids": [t.column("id").to_numpy().tobytes()], "copies": [t.column("copies").to_numpy().tobytes()],
                             "own": [own.tobytes()], "x": [raw]})

        blocks = settled(mine.select("id", "embedding", "copies").mapInArrow(
            assign, "block long, id long, copies long, own long, x binary").repartition(files, "block").groupBy("block")
            .applyInArrow(lambda t: pack(t), "block long, cells array<long>, met array<long>, ids binary, copies binary, own binary, x binary"))
        side = lambda s: blocks.select([F.col(c).alias(s + c) for c in blocks.columns])
        pairs = side("a_").join(side("b_").hint("shuffle_replicate_nl"), F.expr(
            "a_block <= b_block and arrays_overlap(a_met, b_cells)"))
        with small_batches(spark):
            found = settled(pairs.drop("a_met", "a_cells", "b_met", "b_cells").mapInArrow(
                _comparer(least, dim, kind, centres), "id long, links long, to long"))
        counts.append(found.groupBy("id").agg(F.sum("links").alias("links")))
        edges.append(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    none = spark.createDataFrame([], "id long, links long")
    for c in counts:
        none = none.unionByName(c)
    joined = spark.createDataFrame([], "a long, b long")
    for e in edges:
        joined = joined.unionByName(e)
    # Vectors are looked up by their digests, and by themselves only where different ones share a digest.
    short = distinct.select("id", "least", "copies", digest(F.col("embedding")).alias("digest"))
    groups = settled(components(distinct.select("id"), joined).join(short, "id"))
    names = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    known = (groups.join(none, "id", "left").join(names, "component").select(
        "id", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    shared = settled(short.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    asked = rows.select("vec_id", "embedding", digest(F.col("embedding")).alias("digest"))
    if shared.isEmpty():
        found = asked.drop("embedding").join(known, "digest")
    else:
        apart = (distinct.select("id", "embedding", digest(F.col("embedding")).alias("digest"))
                 .join(shared, "digest", "left_semi").join(known.drop("digest"), "id").drop("id", "digest"))
        found = (asked.join(shared, "digest", "left_anti").drop("embedding").join(known, "digest").drop("digest", "id")
                 .unionByName(asked.join(shared, "digest", "left_semi").join(apart, "embedding").drop("embedding", "digest")))
    found = found.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = unusable(vectors).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
