"""Nearest neighbours by robust-pruned directed graphs, one for each shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import settled
from tideline.llm.vectors import matrix, unit, usable


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For many queries in step: the ``width`` nearest points met, and their cosines, nearest first.

    ``graph`` has a row of neighbours for each point, filled up with -1. Each step visits every
    query's nearest point not yet visited and merges its neighbours into the beam; a query ends
    when its whole beam has been visited.
    """
    n = len(queries)
    ids = np.full((n, width), -1, np.int32)
    near = np.full((n, width), -np.inf, np.float32)
    seen = np.ones((n, width), bool)
    ids[:, 0], near[:, 0], seen[:, 0] = start, queries @ x[start], False
    live = np.arange(n)
    while len(live):
        at = np.argmin(seen[live], axis=1)
        seen[live, at] = True
        new = graph[ids[live, at]]
        known = (new[:, :, None] == ids[live][:, None, :]).any(2) | (new < 0)
        close = np.einsum("qd,qrd->qr", queries[live], x[new], optimize=False)
        close[known] = -np.inf
        both = np.concatenate([near[live], close], 1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :width]
        near[live] = np.take_along_axis(both, order, 1)
        ids[live] = np.where(np.isinf(near[live]), -1, np.take_along_axis(np.concatenate([ids[live], new], 1), order, 1))
        seen[live] = np.take_along_axis(np.concatenate([seen[live], known], 1), order, 1) | (ids[live] < 0)
        live = live[~seen[live].all(1)]
    return ids, near


def robust_prune(x: np.ndarray, point: int, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Neighbours for ``point``: nearest first, without those much nearer to one already taken.

    A candidate goes when ``slack`` times its distance to a taken neighbour is no more than its
    distance to the point, which keeps long edges in other directions.
    """
    c = np.unique(candidates[(candidates >= 0) & (candidates != point)])
    far = 1 - x[c] @ x[point]
    order = np.argsort(far, kind="stable")
    c, far = c[order], far[order]
    between = slack * (1 - np.einsum("id,jd->ij", x[c], x[c]))
    open_, taken = np.ones(len(c), bool), []
    for i in range(len(c)):
        if open_[i]:
            taken.append(i)
            if len(taken) == degree:
                break
            open_ &= between[i] > far
    return c[taken]


def build(x: np.ndarray, degree: int = 28, width: int = 64, slack: float = 1.2, seed: int = 7) -> tuple[np.ndarray, int]:
    """The graph over unit vectors ``x`` (float32) and its start, the point nearest to the mean.

    Points are added in batches of doubling size: searches on the graph so far propose
    neighbours, pruning keeps diverse ones, and each gets an edge back.
    """
    n = len(x)
    start = int(np.argmax(x @ x.mean(0)))
    room = degree + degree // 2
    graph = np.full((n, room), -1, np.int32)
    used = np.zeros(n, np.int32)
    rest = np.random.default_rng(seed).permutation(n)
    rest, at, size = rest[rest != start], 0, 1

    def connect(p: int, neighbours: np.ndarray) -> None:
        graph[p, :] = -1
        graph[p, :len(neighbours)] = neighbours
        used[p] = len(neighbours)

    while at < len(rest):
        batch = rest[at:at + size]
        found, _ = beam_search(x, graph, start, x[batch], width)
        for p, candidates in zip(batch.tolist(), found):
            connect(p, robust_prune(x, p, candidates, degree, slack))
        for p in batch.tolist():
            for q in graph[p, :used[p]].tolist():
                if p in graph[q, :used[q]]:
                    continue
                if used[q] == room:
                    connect(q, robust_prune(x, q, np.append(graph[q], p), degree, slack))
                else:
                    graph[q, used[q]] = p
                    used[q] += 1
        at += len(batch)
        size = min(2 * size, 256)
    return graph, start


def search(vectors: DataFrame, every: int = 50, k: int = 5, shard_size: int = 2_000, width: int = 96,
           block: int = 256) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Takes ``vec_id`` and ``embedding``; other columns are left out. Queries are the rows whose id is
    divisible by ``every``; candidates are all rows but the query's own. Score is the cosine in
    double precision; ties go to the smaller id, so equal vectors are indexed once, with
    their k + 1 smallest ids. Every distinct vector is in the graph of one shard of about
    ``shard_size``; each block of queries searches every shard, whose index is a written row. Null
    vectors, zero ones and those with null or non-finite components take no part; vectors meet
    only those of their own length. Fewer candidates give fewer rows; empty tables none.
    """
    spark = vectors.sparkSession
    rows = settled(usable(vectors))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    first = Window.partitionBy("embedding", "salt").orderBy("vec_id")
    then = Window.partitionBy("embedding").orderBy("vec_id")
    members = (salted.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
               .withColumn("place", F.row_number().over(then)).where(F.col("place") <= k + 1))
    members = settled(members.withColumn("rep", F.first("vec_id").over(then)).select("vec_id", "embedding", "rep", "place"))
    reps = members.where("place = 1").select("rep", "embedding", F.size("embedding").alias("dim"))
    sizes = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = -(-sum(sizes.values()) // shard_size)

    def index(table: pa.Table) -> pa.Table:
        ids, raw = table.column("rep").to_numpy(), matrix(table.column("embedding"))
        graph, start = build(unit(raw).astype(np.float32))
        return pa.table({"dim": [raw.shape[1]], "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
                         "ids": [ids.astype(np.int64).tobytes()], "vectors": [raw.tobytes()],
                         "graph": [graph.tobytes()], "start": [start]})

    form = "dim int, shard long, ids binary, vectors binary, graph binary, start long"
    graphs = settled(reps.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards))).groupBy("dim", "shard")
                     .applyInArrow(lambda t: index(t).cast(pa.schema([
                         ("dim", pa.int32()), ("shard", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()),
                         ("graph", pa.binary()), ("start", pa.int64())])), form))
    queries = settled(rows.where(F.col("vec_id") % every == 0).join(reps.select("embedding", "rep"), "embedding")
                      .select(F.col("vec_id").alias("query_id"), "rep"))
    asked = queries.select("rep").distinct().join(reps, "rep")
    blocks = -(-asked.count() // block)
    packed = settled(asked.groupBy("dim", F.pmod(F.xxhash64("rep"), F.lit(max(blocks, 1))).alias("block")).agg(
        F.collect_list(F.struct("rep", "embedding")).alias("asked")))
    # Blocks and indexes meet as two written tables do in nested loops: tasks read both where they lie. A join on the
    # shard would copy each block for every shard, and broadcast those copies by the size of the one block on disk.
    met = graphs.join(packed.hint("shuffle_replicate_nl"), "dim")

    def find(batches):
        for whole in batches:
            for batch in (whole.slice(i, 1) for i in range(whole.num_rows)):
                row = {name: batch.column(i)[0] for i, name in enumerate(batch.schema.names)}
                asked_ = row["asked"].values
                who, q = asked_.field("rep").to_numpy(), matrix(asked_.field("embedding"))
                ids = np.frombuffer(row["ids"].as_py(), np.int64)
                raw = np.frombuffer(row["vectors"].as_py(), np.float64).reshape(len(ids), -1)
                graph = np.frombuffer(row["graph"].as_py(), np.int32).reshape(len(ids), -1)
                hits, _ = beam_search(unit(raw).astype(np.float32), graph, row["start"].as_py(),
                                      unit(q).astype(np.float32), width)
                hits = hits[:, :4 * (k + 1)]
                at, place = np.nonzero(hits >= 0)
                which = hits[at, place]
                score = (unit(q)[at] * unit(raw)[which]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(who[at]), pa.array(ids[which]), pa.array(score)],
                                                 names=["query", "rep", "score"])

    found = met.select("asked", "ids", "vectors", "graph", "start").mapInArrow(find, "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")

    def with_itself(batches):
        for batch in batches:
            u = unit(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), pa.array((u * u).sum(1))],
                                             names=["query", "rep", "score"])

    # A query's own vector is found without the graph, for its copies. Its cosine is computed as all others
    # are, so that a scaled copy ties with an equal one. A batch holds vectors of one length.
    own = None
    for dim in sorted(sizes):
        mine = asked.where(F.col("dim") == dim).select("rep", "embedding").mapInArrow(
            with_itself, "query long, rep long, score double")
        own = mine if own is None else own.unionByName(mine)
    kept = (found.where("query <> rep").withColumn("r", F.row_number().over(best)).where(F.col("r") <= 2 * (k + 1))
            .select("query", "rep", "score").unionByName(own))
    spread = kept.join(members.select("rep", "vec_id"), "rep")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (queries.withColumnRenamed("rep", "query").join(spread, "query").where("query_id <> vec_id")
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
