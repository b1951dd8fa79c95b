"""Exact dedup by deterministic block naming, in DataFrame functions only.

1. Each normalised text is cut into blocks of a fixed number of bytes. Each distinct block gets an
   integer name by its place in sort order.
2. Adjacent names of a text are paired, and each distinct pair gets an integer name in the same
   way, until one name is left. Texts are equal exactly if their numbers of levels and last
   names are.

Names come from comparing whole blocks and pairs, never from trusting a digest: a digest only
says where a block's name is looked up, and another one is taken should two blocks share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import settled

#: Characters that do not count, as in `[\x20\x09-\x0D]`.
IGNORED = r"[\x20\x09-\x0D]+"
#: A name looked up for at least this share of all places is hot; there are at most as many as its inverse.
HOT_SHARE = 0.0005


def normalised(text: Column) -> Column:
    """UTF-8 bytes of a text (null: empty) without blanks and control characters 9 to 13."""
    return F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, ""), "UTF-8")


def blocks(content: Column, size: int) -> Column:
    """Runs of ``size`` bytes, the last one shorter; one empty run for empty content."""
    last = F.greatest(F.ceil(F.octet_length(content) / size), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")),
                       lambda i: F.substring(content, (i * size + 1).cast("int"), F.lit(size)))


def _digest(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(block, F.lit(seed)).alias("x"), F.xxhash64(F.lit(seed), block).alias("y"))


#: Columns of a digest.
DIGEST = ["x", "y"]


def named(things: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` with ``name``, a number in sort order of each partition, and ``places``, the rows they are in.

    Equal keys are added up before they are shuffled. Written out, so that a name stays what
    it is when executors are lost.
    """
    distinct = things.groupBy(*keys).agg(F.count("*").alias("places"))
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def looked_up(rows: DataFrame, names: DataFrame, keys: list[str], places: int) -> DataFrame:
    """``rows`` with the other columns of ``names`` for their ``keys``; each key is there once.

    Keys of many of the ``places`` rows are broadcast: at most 1 / HOT_SHARE of them. The others are
    joined by shuffle, and none of them has more than that share of the rows.
    """
    often = F.col("places") >= max(places * HOT_SHARE, 2)
    hot = F.broadcast(names.where(often))
    rest = rows.join(F.broadcast(names.where(often).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(names.where(~often), keys))


def _block_names(contents: DataFrame, size: int, seed: int) -> tuple[DataFrame, int]:
    """Names of the distinct blocks by digest, and a seed whose digests tell all of them apart."""
    while True:
        distinct = named(contents.select(F.explode(blocks(F.col("content"), size)).alias("block")), ["block"])
        names = settled(distinct.select(_digest(F.col("block"), seed).alias("at"), "name", "places").select(
            "at.*", "name", "places"))
        shared = names.groupBy(*DIGEST).count().where("count > 1")
        if shared.isEmpty():
            return names, seed
        seed += 1


def identities(docs: DataFrame, size: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``docs`` (``id``, ``text``) as ``row``, ``id``, ``length``, ``sha256``; and for each row ``levels`` and ``name``."""
    contents = docs.select("id", "text", normalised(F.col("text")).alias("content"))
    names, seed = _block_names(contents, size, seed)
    rows = settled(contents.select(
        F.monotonically_increasing_id().alias("row"), "id",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("length"),
        F.sha2("content", 256).alias("sha256"),
        F.transform(blocks(F.col("content"), size), lambda b: _digest(b, seed)).alias("digests")))
    places = names.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    here = rows.select("row", F.posexplode("digests").alias("pos", "at")).select(
        "row", F.col("pos").cast("long").alias("pos"), "at.*")
    now = settled(looked_up(here, names, DIGEST, places).select("row", "pos", "name"))
    level, done = 0, []
    while True:
        # A text is through once one name is left; it is the only one at place 0 with none at place 1.
        pairs = now.groupBy("row", F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"))
        pairs = settled(pairs.withColumn("right", F.coalesce("right", F.lit(-1))))
        rest = pairs.groupBy("row").agg(F.max("pos").alias("last"), F.max("right").alias("right"))
        single = rest.where("last = 0 and right = -1").select("row")
        done.append(pairs.join(single, "row", "left_semi").select(
            "row", F.lit(level).alias("levels"), F.col("left").alias("name")))
        open_pairs = settled(pairs.join(single, "row", "left_anti"))
        places = open_pairs.count()
        if not places:
            break
        names = settled(named(open_pairs, ["left", "right"]))
        now = settled(looked_up(open_pairs, names, ["left", "right"], places).select("row", "pos", "name"))
        level += 1
    ends = done[0]
    for more in done[1:]:
        ends = ends.unionByName(more)
    return rows.drop("digests"), settled(ends)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = 4096) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical without blanks and control characters 9 to 13. Of equal
    texts the row with the most code points in the original text stays, then the one of least
    ``key``, null last; of rows equal in both, one. Null texts are empty, and all empty or blank
    texts are equal. Ids may be null or repeat, rows are told apart by themselves. Other columns
    are ignored, whatever their names. An empty table gives an empty table. A text of any length
    is a row here as it is in ``docs``; only block names of it are gathered.
    """
    plain = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    rows, ends = identities(plain, block_bytes)
    known = settled(rows.join(ends, "row"))
    places = known.count()
    whole = ["levels", "name"]
    groups = settled(known.groupBy(*whole).agg(
        F.count("*").alias("places"),
        F.min(F.struct((-F.col("length")).alias("less"), F.col("id").isNull().alias("none"), "id", "row")).alias("best")))
    picked = groups.select(*whole, "places", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    return looked_up(known, picked, whole, places).select(
        F.col("id").alias("doc_id"), "keep_id", F.col("places").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha256").alias("text_sha256"))


def oracle_sql() -> str:
    """The same rows in DuckDB: grouping by the normalised text itself."""
    return r"""
    with n as (
        select doc_id, coalesce(length(text), 0) as size,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as body, row_number() over () as r
        from documents),
    g as (
        select *, first_value(doc_id) over w as keep_id, first_value(r) over w as keep_r,
               count(*) over (partition by body) as group_size
        from n window w as (partition by body order by size desc, doc_id nulls last, r))
    select doc_id, keep_id, group_size, r = keep_r as kept, sha256(body) as text_sha256 from g"""
