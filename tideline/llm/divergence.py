"""Source divergence audit by three-dimensional cube partitioning.

Every group (language and source) has smoothed, whole-number shares of its language's kept terms.
Divergence of two groups is a sum over terms. A task owns a cell (group block, group block, term
block) of a language: slices of term counts are copied to the cells that need them, each cell sums
its pairs of groups over its terms, and cells are added up along the term axis. A group, a
language or a term of any size is thus spread over cells of bounded size.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import settled
from tideline.llm.tokens import slices
from tideline.operators.joins import join_measured, measured

#: Shares are whole numbers of this many parts.
PARTS = 1_000_000_000
#: Groups of a block and terms of a block, on average.
GROUPS, TERMS = 64, 8192
#: Distinct (group, term) counts held in a task before they are handed on.
HELD = 400_000
#: Bytes: letters A-Z become small, all other ASCII but a-z parts terms, bytes from 128 up belong to terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: What a group is.
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group of ``docs``.

    Summed within tasks first, so what is shuffled depends on distinct terms only.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, Counter] = defaultdict(Counter)
        seen: dict[tuple, Counter] = defaultdict(Counter)

        def hand_on():
            for (lang, source), terms in sums.items():
                names, size = list(terms), len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(names, pa.binary()),
                     pa.array(list(terms.values()), pa.int64()),
                     pa.array([seen[lang, source][t] for t in names], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            sums.clear()
            seen.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                    here = Counter(text.translate(LETTERS).split())
                    sums[lang, source].update(here)
                    seen[lang, source].update(here.keys())
                if sum(map(len, sums.values())) > HELD:
                    yield from hand_on()
        yield from hand_on()

    found = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(
        count, "lang string, source string, term binary, n long, docs long")
    return (found.groupBy("lang", "source", F.col("term").cast("string").alias("term"))
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (n + 2) / (total + 2 * terms)), exact for totals up to 10^15."""
    wide = F.lit(PARTS).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return F.call_function("div", wide, (total + 2 * terms).cast("decimal(19,0)")) + 1


def shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The same by long division in steps of a thousand, which fits 64 bits."""
    rest, out = n + 2, np.zeros_like(n)
    total = total + 2 * terms
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def counts(docs: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms, and all groups.

    ``lang, source, term, n, in_lang, first`` for terms in at least ``least_docs`` documents of their
    language, ``first`` true in one row for each term of a language; and ``lang, source, total,
    terms, lang_total`` for each group, with its and its language's number of kept occurrences
    and the number of kept terms.
    """
    by_term = Window.partitionBy("lang", "term")
    kept = (term_counts(docs)
            .withColumn("in_docs", F.sum("docs").over(by_term)).withColumn("in_lang", F.sum("n").over(by_term))
            .withColumn("first", F.row_number().over(by_term.orderBy("source")) == 1)
            .where(F.col("in_docs") >= least_docs).drop("docs", "in_docs"))
    kept = settled(kept)
    sums = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
    groups = (docs.select(*GROUP).distinct().join(sums, GROUP, "left").join(langs, "lang", "left")
              .na.fill(0, ["total", "terms", "lang_total"]))
    return kept, settled(groups)


def _sides(rows: DataFrame) -> DataFrame:
    """Copies of ``rows`` (with ``block``, ``blocks``) for each pair of group blocks that theirs is in."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("other")


def _cell(rows: pa.Table) -> pa.Table:
    """Partial divergence of each pair of a cell's groups. Markers (null term) name its groups and their totals."""
    marks = rows.filter(pc.is_null(rows.column("term"))).sort_by("source")
    body = rows.filter(pc.is_valid(rows.column("term")))
    first = marks.slice(0, 1).to_pylist()[0]
    names = marks.column("source").to_pylist()
    total, block = (marks.column(c).to_numpy().astype(np.int64) for c in ("total", "block"))
    terms = int(first["terms"])
    zero = shares(np.zeros_like(total), total, terms) if terms else np.ones_like(total)
    coded = body.column("term").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    width = len(coded.dictionary)
    line = pc.index_in(body.column("source"), marks.column("source").combine_chunks()).to_numpy().astype(np.int64)
    p = np.repeat(zero[:, None], width, 1)
    n = body.column("n").to_numpy().astype(np.int64)
    if width:
        p[line, coded.indices.to_numpy()] = shares(n, total[line], terms)
    unseen = int(first["here"]) - width
    left, right, value = [], [], []
    for i in range(len(names)):
        if block[i] != first["a"]:
            continue
        # Within a block each pair once; from one block to another all.
        to = np.flatnonzero(block == first["b"]) if first["a"] != first["b"] else np.arange(i + 1, len(names))
        if len(to):
            left += [names[i]] * len(to)
            right += [names[j] for j in to]
            value += (apart(p[i], p[to]).sum(1) + unseen * apart(zero[i], zero[to])).tolist()
    return pa.table({"lang": pa.array([first["lang"]] * len(left), pa.string()), "left": pa.array(left, pa.string()),
                     "right": pa.array(right, pa.string()), "value": pa.array(value, pa.int64())})


def pairs(kept: DataFrame, groups: DataFrame, group_block: int = GROUPS, term_block: int = TERMS) -> DataFrame:
    """``lang, left, right, value`` for each two sources of a language, once, summed over all kept terms."""
    sizes = measured(groups.groupBy("lang").agg(
        F.ceil(F.count("*") / group_block).cast("int").alias("blocks"), F.first("terms").alias("terms")))
    cube = sizes[0].withColumn("slabs", F.greatest(F.ceil(F.col("terms") / term_block), F.lit(1)).cast("int"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    slab = F.pmod(F.xxhash64("term"), F.col("slabs")).cast("int")
    placed = settled(join_measured(kept, (cube.drop("terms"), sizes[1]), ["lang"], "inner").select(
        "lang", "source", "term", "n", "first", "blocks", block.alias("block"), slab.alias("slab")))
    here = placed.groupBy("lang", "slab").agg(F.count_if("first").alias("here"))
    marks = join_measured(groups.select(*GROUP, "total", "terms"), (cube.drop("terms"), sizes[1]), ["lang"], "inner").select(
        "*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab"))
    marks = marks.join(here, ["lang", "slab"], "left").na.fill(0, ["here"])
    null = F.lit(None)
    columns = ["lang", "source", "term", "n", "total", "terms", "here", "block", "a", "b", "slab"]
    rows = _sides(placed).withColumns({c: null.cast("long") for c in ("total", "terms", "here")}).select(*columns)
    marked = _sides(marks).withColumns({"term": null.cast("string"), "n": null.cast("long")}).select(*columns)
    cells = rows.unionByName(marked).groupBy("lang", "a", "b", "slab").applyInArrow(
        _cell, "lang string, left string, right string, value long")
    return cells.groupBy("lang", "left", "right").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` of all groups of ``docs`` (``text``, ``lang``, ``source``).

    Part ``pair``: every other source of the language with its divergence. Part ``term``: the ``top``
    terms that raise a group's divergence from its language most, of those it has more of. Ranks
    are from 1 per group and part, by value descending, then item by code point. Nulls are ''.
    A group whose documents hold no kept term still has pairs, of value 0 where the language
    keeps no term; a language of one source has no pairs. Repeated rows count as often as they occur,
    other columns are ignored. An empty table gives an empty table. Texts count whole.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", *GROUP)])
    kept, groups = counts(plain, least_docs)
    found = pairs(kept, groups)
    both = found.select("lang", F.explode(F.array(
        F.struct(F.col("left").alias("source"), F.col("right").alias("item")),
        F.struct(F.col("right").alias("source"), F.col("left").alias("item")))).alias("e"), "value").select(
        "lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    own = (join_measured(kept, measured(groups), GROUP, "inner")
           .select(*GROUP, "term", p.cast("long").alias("p"), q.cast("long").alias("q")).where("p > q")
           .select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"),
                   F.expr("(p - q) * (p - q) div (p + q)").alias("value")))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).alias("rank")
    return both.select("*", ranked).unionByName(own.select("*", ranked).where(F.col("rank") <= top))


def oracle_sql() -> str:
    """The same rows in DuckDB, with 128-bit integers."""
    return r"""
    with d as (
        select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body
        from documents),
    t as (select r, lang, source, unnest(regexp_extract_all(body, '[a-z\x{80}-\x{10FFFF}]+')) as term from d),
    k as (select lang, term, count(*) as in_lang from t group by lang, term having count(distinct r) >= 10),
    l as (select lang, count(*) as v, sum(in_lang) as lang_total from k group by lang),
    c as (select t.lang, t.source, t.term, count(*) as n from t join k using (lang, term) group by all),
    g as (select lang, source, coalesce(v, 0) as v, coalesce(lang_total, 0) as lang_total, coalesce(total, 0) as total
          from (select distinct lang, source from d) left join l using (lang)
          left join (select lang, source, sum(n) as total from c group by all) using (lang, source)),
    p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
                 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) as p,
                 1 + 1000000000::hugeint * (k.in_lang + 2) // (g.lang_total + 2 * g.v) as q
          from g join k using (lang) left join c using (lang, source, term)),
    f as (select a.lang, a.source, b.source as item, (a.p - b.p) * (a.p - b.p) // (a.p + b.p) as f
          from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source),
    pairs as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(s.value, 0)::bigint as value
              from g join g h on g.lang = h.lang and g.source <> h.source
              left join (select lang, source, item, sum(f) as value from f group by all) s
                on s.lang = g.lang and s.source = g.source and s.item = h.source),
    terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
              from p where n > 0 and p > q)
    select lang, source, part, item, value,
           (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
    from (select * from pairs union all select * from terms)
    qualify part = 'pair' or rank <= 10"""
