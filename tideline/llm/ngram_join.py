"""Jaccard self-join on word shingles: size-aware, heavy-light.

1. A filter on all documents. In an order by hash, two sets with Jaccard of at least t have k
   elements in common among the first n - ceil(t n) + k of each. A set with fewer than k
   elements there that any other set has can have no partner.
2. Elements of what is left are ordered by how many sets have them, rarest first. Small sets
   enumerate the 2-subsets of their prefix (two similar sets have one in common); large sets
   scan the inverted lists of the elements of theirs. The size from which scanning is cheaper
   is the boundary.
3. Lists with the same members count once. An entry knows how many common elements its set can still have
   if this is where it meets another first; two entries that can't have enough together are not compared.
4. Sets that meet are compared exactly, by rounds: with one hub of each list first, the one whose elements
   most sets have, then with eight, sixty-four, ... of what is left. What a round connects needs no
   more comparing, and a hub that met its whole list leaves it, so a large group of near copies
   needs few comparisons per member, and rounds go on until no list is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import components, fanout, settled
from tideline.llm.shingles import shingle_sets
from tideline.llm.tokens import slices
from tideline.operators.joins import join_keyed

#: Share of a set that the first filter wants to find elsewhere. Changes cost, not results.
SLACK = 0.05
#: Hubs of a list are this many times more in each round. Changes cost, not results.
HUB_GROWTH = 8
#: Bytes of hashes a task holds at a time.
BUCKET_BYTES = 16 << 20


def least_overlap(n, percent: int):
    """Least intersection of a set of n elements with any set it links with."""
    return (percent * n + 99) // 100


def least_overlap_column(n, percent: int):
    return F.floor((percent * n + 99) / 100)


def class_id(hashes: np.ndarray) -> int:
    """Signed 64-bit digest of a set; equal sets share it."""
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes()), "big", signed=True)


def _batches(source: Iterator[pa.RecordBatch], column: str, size: int):
    for whole in source:
        for batch in slices(whole, column, 1_500_000):
            at = batch.schema.get_field_index(column)
            # Hashing takes some sixty bytes per character at a time.
            yield batch, [s for part in slices(batch, column, 300_000)
                          for s in shingle_sets(part.column(at).to_pylist(), size)]


def digests(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``class``, which equal sets share; null for an empty set."""
    def digest(batches):
        for batch, sets in _batches(batches, "text", size):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([class_id(s) if len(s) else None for s in sets], pa.int64())],
                names=["doc_id", "n_shingles", "class"])

    return docs.mapInArrow(digest, "doc_id long, n_shingles long, class long")


def _dealt(hashes: np.ndarray, refs: np.ndarray, sizes: np.ndarray, buckets: int,
           credits: tuple[bytes, bytes] = (b"", b"")) -> pa.RecordBatch:
    """One row per bucket of hashes. The classes they belong to come as runs: class, set size, length.

    ``hashes`` must be grouped by class.
    """
    bucket = (hashes % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, refs, hashes = bucket[order], refs[order], hashes[order]
    runs = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (refs[1:] != refs[:-1])])
    lengths = np.diff(np.r_[runs, len(bucket)]).astype(np.int32)
    which, start = np.unique(bucket, return_index=True)
    ends = np.r_[start[1:], len(bucket)]
    low, high = np.searchsorted(runs, start), np.searchsorted(runs, ends)
    cut = lambda x, a, b: pa.array([x[i:j].tobytes() for i, j in zip(a, b)], pa.binary())
    first = lambda x: pa.array([x] + [b""] * (len(which) - 1), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(which), cut(hashes, start, ends), cut(refs[runs], low, high),
         cut(sizes[order][runs].astype(np.int32), low, high), cut(lengths, low, high), *map(first, credits)],
        names=["bucket", "hashes", "classes", "sizes", "lengths", "credited", "credit"])


DEALT = "bucket int, hashes binary, classes binary, sizes binary, lengths binary, credited binary, credit binary"


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def bucket_count(docs: DataFrame, hashes: float) -> int:
    """Buckets of hashes: as many as the cluster's partitions, more if they would hold too much each."""
    return max(fanout(docs.sparkSession), int(8 * hashes // BUCKET_BYTES) + 1)


def shared_counts(docs: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """``class`` and ``shared``: elements of its hash-order prefix that some other class has.

    Within a batch an element travels with two of its classes at most, the others are credited
    at once, so that a very frequent shingle is no heavier than the number of batches.
    """
    def emit(batches):
        for _, sets in _batches(batches, "text", size):
            classes = {class_id(s): s for s in sets if len(s)}
            if not classes:
                continue
            pre = []
            for s in classes.values():
                n = len(s)
                pre.append(s[:n - least_overlap(n, percent) + max(1, int(SLACK * n))])
            hashes = np.concatenate(pre)
            refs = np.repeat(np.array(list(classes), np.int64), [len(p) for p in pre])
            order = np.argsort(hashes, kind="stable")
            hashes, refs = hashes[order], refs[order]
            start = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            nth = np.arange(len(hashes)) - np.repeat(start, np.diff(np.r_[start, len(hashes)]))
            who, times = np.unique(refs[nth > 1], return_counts=True)
            keep = np.flatnonzero(nth < 2)
            keep = keep[np.argsort(refs[keep], kind="stable")]
            yield _dealt(hashes[keep], refs[keep], np.zeros(len(keep)), buckets,
                         (who.tobytes(), times.astype(np.int64).tobytes()))

    def count(table: pa.Table) -> pa.Table:
        hashes = _joined(table, "hashes", np.uint64)
        refs = np.repeat(_joined(table, "classes", np.int64), _joined(table, "lengths", np.int32))
        order = np.lexsort((refs, hashes))
        hashes, refs = hashes[order], refs[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (refs[1:] != refs[:-1])]
        hashes, refs = hashes[new], refs[new]
        same = hashes[1:] == hashes[:-1]
        both = np.r_[same, False] | np.r_[False, same]
        who, times = np.unique(refs[both], return_counts=True)
        return pa.table({"class": np.r_[who, _joined(table, "credited", np.int64)],
                         "shared": np.r_[times.astype(np.int64), _joined(table, "credit", np.int64)]})

    dealt = docs.mapInArrow(emit, DEALT)
    return (dealt.groupBy("bucket").applyInArrow(count, "class long, shared long")
            .groupBy("class").agg(F.sum("shared").alias("shared")))


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``class``, ``n``, ``hashes`` of the wanted classes, read again from one document of each."""
    def sets_of(batches):
        for batch, sets in _batches(batches, "text", size):
            want = batch.column(batch.schema.get_field_index("class")).to_pylist()
            rows = [(w, len(s), s.tobytes()) for w, s in zip(want, sets) if len(s) and class_id(s) == w]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))],
                    names=["class", "n", "hashes"])

    picked = join_keyed(docs, wanted.select("doc_id", "class"), ["doc_id"], "inner")
    return picked.select("text", "class").mapInArrow(sets_of, "class long, n long, hashes binary").dropDuplicates(["class"])


def prefixes(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """``class``, ``n``, ``shared``, ``centre``, ``prefix``: shared elements, those that fewest sets have first.

    ``shared`` is how many elements other sets have too, ``centre`` how many sets have an element on average.
    Elements that one set alone has come first in this order and can be left out, but they take
    places: what is kept is n - ceil(t n) + 2 long, less those. One kept element more than
    single elements need makes room for 2-subsets.
    """
    def emit(batches):
        for batch in batches:
            refs, n, raw = (c.to_pylist() for c in batch.columns)
            sizes = [len(r) // 8 for r in raw]
            yield _dealt(np.frombuffer(b"".join(raw), np.uint64),
                         np.repeat(np.array(refs, np.int64), sizes), np.repeat(np.array(n, np.int64), sizes), buckets)

    def frequencies(table: pa.Table) -> pa.Table:
        hashes = _joined(table, "hashes", np.uint64)
        lengths = _joined(table, "lengths", np.int32)
        refs = np.repeat(_joined(table, "classes", np.int64), lengths)
        n = np.repeat(_joined(table, "sizes", np.int32), lengths).astype(np.int64)
        _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        times = times[back]
        keep = times > 1
        return pa.table({"class": refs[keep], "n": n[keep], "hash": hashes[keep].view(np.int64),
                         "sets": times[keep].astype(np.int64)})

    shared = (sets.mapInArrow(emit, DEALT)
              .groupBy("bucket").applyInArrow(frequencies, "class long, n long, hash long, sets long"))
    # One set's elements at most: no more than its document has.
    mine = Window.partitionBy("class")
    ranked = shared.withColumns({"rank": F.row_number().over(mine.orderBy("sets", "hash")), "shared": F.count("*").over(mine),
                                "centre": F.sum("sets").over(mine) / F.col("n")})
    first = ranked.where(F.col("rank") <= F.col("shared") + 2 - least_overlap_column(F.col("n"), percent))
    return first.groupBy("class", "n", "shared", "centre").agg(F.sort_array(F.collect_list(F.struct("rank", "hash"))).alias("all")).select(
        "class", "n", "shared", "centre", F.transform("all", lambda e: e["hash"]).alias("prefix"))


def boundary(ordered: DataFrame, percent: int) -> int:
    """The set size up to which enumerating 2-subsets costs less than scanning lists.

    Costs by size class (each a quarter larger than the last, so a few dozen rows): subsets that
    the small sets write; list entries that the large ones and those near the boundary write
    and that are then compared with a hub. A set larger than the one with a short prefix costs
    more as subsets, however few there are of it.
    """
    length = F.size("prefix")
    rows = (ordered.groupBy(F.floor(F.log("n") / F.log(F.lit(1.25))).alias("step")).agg(
        F.max("n").alias("n"), F.sum(length * (length - 1) / 2).alias("subsets"),
        F.sum(2 * (length - 1)).alias("scanned")).orderBy("step").collect())
    best, chosen = None, 0
    for i in range(len(rows) + 1):
        top = rows[i - 1]["n"] if i else 0
        cost = sum(r["subsets"] for r in rows[:i]) + sum(
            r["scanned"] for r in rows if r["n"] * 100 >= percent * top)
        if best is None or cost < best:
            best, chosen = cost, top
    return chosen


def meeting_keys(ordered: DataFrame, limit: int, percent: int) -> DataFrame:
    """``key``, ``cap``, ``class``, ``n``, ``centre``, ``heavy``: sets that may link share a key, and one of a heavy key is large.

    ``cap`` is the most elements a set can have in common with one that it shares no earlier key with:
    those of the key and the shared ones that come after them.
    """
    rest = ["class", "n", "centre"]
    light = ordered.where((F.col("n") <= limit) & (F.size("prefix") > 1))
    pairs = F.expr("flatten(transform(sequence(1, size(prefix) - 1), i -> transform(sequence(i + 1, size(prefix)), "
                   "j -> struct(xxhash64(least(prefix[i - 1], prefix[j - 1]), greatest(prefix[i - 1], prefix[j - 1])) AS key, "
                   "shared - j + 2 AS cap))))")
    subsets = light.select(F.explode(pairs).alias("e"), *rest).select("e.*", *rest, F.lit(False).alias("heavy"))
    near = ordered.where((F.col("n") > limit) | (F.col("n") * 100 >= limit * percent))
    singles = near.where(F.size("prefix") > 1).select(
        F.posexplode(F.expr("slice(prefix, 1, size(prefix) - 1)")).alias("at", "key"), "shared", *rest).select(
        "key", (F.col("shared") - F.col("at")).alias("cap"), *rest, F.lit(True).alias("heavy"))
    return subsets.unionByName(singles)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs ``a``, ``b`` (and their labels ``la``, ``lb``) those that link, by exact intersection."""
    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4), batch.column(5)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    met = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    some = join_keyed(sets, met, ["class"], "left_semi")
    one = some.select(F.col("class").alias("a"), F.col("hashes").alias("left"))
    two = some.select(F.col("class").alias("b"), F.col("hashes").alias("right"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "la", "lb", "left", "right").mapInArrow(
        check, "a long, b long, la long, lb long")


def lists_once(keys: DataFrame, limit: int) -> DataFrame:
    """Rows of one list for each set of members that can hold a link.

    Of lists with the same members the one whose elements come first stays: there all caps are the largest,
    and two members that link meet first in no other of them.
    """
    digest = [F.bit_xor(F.xxhash64("class", F.lit(i))).alias(f"d{i}") for i in range(2)]
    stats = keys.groupBy("key", "heavy").agg(F.count("*").alias("c"), F.max("n").alias("top"), F.sum("cap").alias("caps"), *digest)
    useful = stats.where("c > 1").where(~F.col("heavy") | (F.col("top") > limit))
    one = useful.groupBy("c", "d0", "d1").agg(F.max(F.struct("caps", "key", "heavy")).alias("l")).select("l.key", "l.heavy")
    return keys.join(one, ["key", "heavy"])


def class_links(sets: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Links ``a``, ``b`` between classes: enough to connect all that link, by comparing what shares a list."""
    limit = boundary(ordered, percent)
    keys = settled(lists_once(meeting_keys(ordered, limit, percent), limit).withColumn("label", F.col("class")))
    fits = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (
        (100 + percent) * F.least("cap", "hub_cap") >= percent * (F.col("n") + F.col("m")))
    on = ["key", "heavy"]
    links = tried = sets.sparkSession.createDataFrame([], "a long, b long")
    hubs_each = 1
    while not keys.isEmpty():
        # The same order in all lists, so that lists with many members in common choose the same hubs.
        by_label = [F.xxhash64("label", F.lit(hubs_each))] if hubs_each > 1 else []
        order = Window.partitionBy(*on).orderBy(*by_label, F.desc("centre"), "class")
        hubs = settled(keys.withColumn("place", F.row_number().over(order)).where(F.col("place") <= hubs_each).select(
            *on, F.col("class").alias("hub"), F.col("n").alias("m"), F.col("cap").alias("hub_cap"), F.col("label").alias("hub_label")))
        first = F.col("class") < F.col("hub")
        pairs = (keys.join(hubs, on).where("label <> hub_label").where(fits).select(
            F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b"),
            F.when(first, F.col("label")).otherwise(F.col("hub_label")).alias("la"),
            F.when(first, F.col("hub_label")).otherwise(F.col("label")).alias("lb")).distinct())
        pairs = settled(pairs.join(tried, ["a", "b"], "left_anti") if hubs_each > 1 else pairs)
        found = settled(verified(pairs, sets, percent))
        tried, links = tried.unionByName(pairs.select("a", "b")), links.unionByName(found.select("a", "b"))
        # What is connected takes one label and needs no more comparing. A hub is done with its list.
        named = found.select(F.col("la").alias("id")).union(found.select("lb")).distinct()
        moves = components(named, found.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(
            F.col("id").alias("label"), F.col("component").alias("to"))
        left = keys.join(hubs.select(*on, F.col("hub").alias("class")), [*on, "class"], "left_anti")
        left = settled(join_keyed(left, moves, ["label"]).withColumn("label", F.coalesce("to", "label")).drop("to"))
        still = left.groupBy(*on).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        keys = settled(join_keyed(left, still.select(*on), on, "left_semi"))
        hubs_each *= HUB_GROWTH
    return links


def join(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the least id that links lead to, itself included.

    Takes ``doc_id`` and ``text``; other columns are left out. Documents link when 100 times their
    intersection is at least ``percent`` times their union. A null, empty or wordless text has an
    empty set and no link. Equal sets are one class from the start, whatever their number; repeated
    rows each get a row; rows without an id get no component. An empty table gives an empty one.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    every = settled(digests(own, size))
    classes = settled(every.where("class is not null and doc_id is not null").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")))
    wanted = F.greatest(F.lit(1), F.floor(F.col("n") * SLACK))
    elements = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = bucket_count(docs, elements * ((100 - percent) / 100 + SLACK))
    left = settled(shared_counts(own.where("doc_id is not null"), size, percent, buckets).join(classes, "class").where(F.col("shared") >= wanted))
    sets = settled(whole_sets(own, left, size))
    elements = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ordered = settled(prefixes(sets, percent, bucket_count(docs, elements)))
    links = settled(class_links(sets, ordered, percent))
    nodes = classes.select(F.col("class").alias("id"), "doc_id")
    grouped = components(nodes, links)
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(least, "component").select(F.col("id").alias("class"), "component_id")
    return every.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
