"""Exact dedup, whitening and the divergence audit against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import divergence, exact_dedup, whitening
from tideline.llm import queries

GAPS = re.compile("[ \t-\r]")


def kept_rows(rows):
    """doc_id, keep_id, group_size, kept, sha256 of each row, as a multiset."""
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[GAPS.sub("", text or "")].append((-len(text or ""), doc is None, doc or 0, i))
    out = Counter()
    for body, members in groups.items():
        best = min(members)
        digest = hashlib.sha256(body.encode()).hexdigest()
        for m in members:
            out[rows[m[3]][0], rows[best[3]][0], len(members), m == best, digest] += 1
    return out


def odd_texts():
    rng = random.Random(5)
    long = "".join(rng.choice("abc é漢🙂\n") for _ in range(30_000))
    texts = [None, "", " \t\r\n\x0b\x0c", "a b", "ab", "a\tb ", "A b", "\x00a", "a\x1fb", "a b", long, long + "x",
             long.replace(" ", "\t "), long[:20_000], "ab" * 8, "ab" * 8 + "a", "a" * 16, "a" * 17, "a" * 8 + "b" * 8]
    texts += ["copy of many"] * 150 + [rng.choice(["x y z", "xyz ", "x yz"]) for _ in range(60)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(20))) for _ in range(200)]
    ids = [*range(len(texts) - 30), *[None] * 10, *range(20)]
    return list(zip(ids, texts))


@pytest.mark.parametrize("size", [2, 4096])
def test_equal_texts_are_named_alike(spark, size):
    rows = odd_texts() if size > 2 else [r for r in odd_texts() if len(r[1] or "") < 9]
    df = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows],
                               "doc_id long, text string, name int, places int, row string")
    got = Counter(map(tuple, exact_dedup.dedup(df, block_bytes=size).collect()))
    assert got == kept_rows(rows)


def test_digests_that_fail_to_tell_blocks_apart_are_replaced(spark, monkeypatch):
    real = exact_dedup._digest

    def weak(block, seed):
        few = lambda d: F.struct((d["x"] % 7).alias("x"), F.lit(0).cast("long").alias("y"))
        return few(real(block, seed)) if seed < 2 else real(block, seed)

    monkeypatch.setattr(exact_dedup, "_digest", weak)
    rows = [r for r in odd_texts() if len(r[1] or "") < 40]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, exact_dedup.dedup(df, block_bytes=8).collect())) == kept_rows(rows)


def test_no_documents_give_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert exact_dedup.dedup(none).collect() == []
    assert divergence.audit(none).collect() == []
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def vectors(spark, x, more=()):
    rows = [(i, v, "other", 1.0) for i, v in [*enumerate(x.tolist()), *more]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, whitened double")


def plain_whitening(x):
    x = np.floor(64 * x).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    y = (n * x - sums) / n
    _, s, v = np.linalg.svd(y, full_matrices=False)
    away = [sum(d * d for d in row) for row in (n * x - sums).astype(object).tolist()]
    return y, s ** 2 / n, v, away


ODD = [(900, None), (901, [math.nan] + [0.0] * 11), (902, [None] + [0.0] * 11), (903, [math.inf] + [0.0] * 11), (904, [])]


def compared(spark, x, k, more=()):
    y, variance, v, away = plain_whitening(x)
    model = whitening.fit(whitening.usable(vectors(spark, x, more)), k)
    rows = whitening.whiten(vectors(spark, x, more), k).collect()
    k = len(model.variance)
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, c + 1) for i in range(len(x)) for c in range(k)]
    got = np.zeros((len(x), k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == len(x) and r.deviation == away[r.vec_id]
        assert abs(r.explained / (variance[r.component - 1] / variance.sum()) - 1) < 1e-6
    want = y @ v[:k].T / np.sqrt(variance[:k])
    return got, want * np.sign((got * want).sum(0)), max(r.identity_error for r in rows)


def test_vectors_are_whitened(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12)) * np.arange(1, 13) * 3
    x[:100] = x[0]  # a third of all rows are equal
    got, want, error = compared(spark, x, 8, ODD)
    assert got.shape == (300, 8) and np.abs(got - want).max() < 1e-9 and error < 1e-9


def test_ill_conditioned_vectors_keep_their_small_directions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)) * [1e9, 1e5, 10, 10]
    x = np.c_[x, x[:, 0] + rng.normal(size=400)]
    got, want, error = compared(spark, x, 5)
    # Of the plain covariance, the last directions are lost in rounding.
    assert got.shape == (400, 5) and error < 1e-4 and np.abs(got - want).max() < 1e-2


def test_directions_without_variance_are_none(spark):
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(200, 3)) * 640) / 64
    x = np.c_[x, x[:, 0] + x[:, 1], np.full(200, 7.0), x[:, 2]]
    got, want, error = compared(spark, x, 6)
    assert got.shape == (200, 3) and np.abs(got - want).max() < 1e-8 and error < 1e-9
    assert whitening.whiten(vectors(spark, np.ones((5, 3)))).collect() == []
    assert whitening.whiten(vectors(spark, np.ones((1, 3)))).collect() == []


def test_fewer_vectors_than_dimensions(spark):
    got, want, error = compared(spark, np.random.default_rng(6).normal(size=(4, 6)) * 50, 6)
    assert got.shape == (4, 3) and np.abs(got - want).max() < 1e-8 and error < 1e-9


def test_ids_may_be_null_or_repeat_and_lengths_may_not_differ(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [4.0, 9.0])], "vec_id long, embedding array<float>")
    assert sorted(r.vec_id or 0 for r in whitening.whiten(df).collect()) == [0, 1, 1]
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))


def test_deviation_of_many_rows_is_exact():
    model = whitening.Whitening(3_000_000_000, np.array([3_000_000_000 * 1_000_000 + 17] * 3), np.zeros((0, 3)), *[np.zeros(0)] * 2)
    x = np.array([[1_000_064, 1_000_000, 900_000]])
    assert whitening.deviation(x, model) == [sum((3_000_000_000 * v - model.sums[0].item()) ** 2 for v in x[0].tolist())]


def brute_audit(rows, least, top):
    terms = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}
    in_docs, n, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        found = terms.findall(text.translate(lower))
        in_docs.update((lang, t) for t in set(found))
        n.update((lang, source, t) for t in found)
    out = []
    for lang, source in groups:
        kept = sorted(t for g, t in in_docs if g == lang and in_docs[g, t] >= least)
        own = sorted(s for g, s in groups if g == lang)

        def parts(sources):
            c = [sum(n[lang, s, t] for s in sources) for t in kept]
            return [1 + 10 ** 9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]

        p = parts([source])
        pair = [("pair", s, sum((a - b) ** 2 // (a + b) for a, b in zip(p, parts([s])))) for s in own if s != source]
        term = [("term", t, (a - b) ** 2 // (a + b)) for t, a, b in zip(kept, p, parts(own)) if n[lang, source, t] and a > b]
        for found, limit in ((pair, None), (term, top)):
            found.sort(key=lambda f: (-f[2], f[1].encode()))
            out += [(lang, source, *f, i + 1) for i, f in enumerate(found[:limit])]
    return sorted(out)


def audited(spark, rows, least=2, top=3, **blocks):
    df = spark.createDataFrame([(*r, 5, "n") for r in rows], "text string, lang string, source string, total int, term string")
    if not blocks:
        return sorted(map(tuple, divergence.audit(df, least, top).collect()))
    plain = df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return sorted(tuple(r) for r in divergence.pairs(*divergence.counts(plain, least), **blocks).collect())


def corpus():
    rng = random.Random(8)
    words = ["Haus", "haus", "été", "ÉTÉ", "x", "don't", "a1b", "漢字", "z y", "Ω", "🙂", "q", "r", "ſ", "K"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "en", "de", None]),
             rng.choice(["s1", "S1", "ä", "z", "", None, *["big"] * 6])) for _ in range(150)]
    return rows + [(None, "en", "empty"), ("", "xx", "lonely"), ("unique", "yy", "a"), ("rare", "yy", "b"), ("w " * 4000, "en", "s1")]


def test_audit_equals_brute_force(spark):
    rows = corpus()
    assert audited(spark, rows) == brute_audit(rows, 2, 3)
    assert audited(spark, rows, least=1000) == brute_audit(rows, 1000, 3)


def test_any_size_of_blocks_gives_the_same_sums(spark):
    rows = corpus()
    whole = audited(spark, rows, group_block=100, term_block=100)
    cut = audited(spark, rows, group_block=2, term_block=3)
    both = lambda found: sorted((lang, *sorted([a, b]), v) for lang, a, b, v in found)
    assert whole and both(whole) == both(cut)


def test_shares_agree_and_are_exact_for_large_counts(spark):
    n, total, terms = [0, 7, 10 ** 9 + 7, 9 * 10 ** 14], [10 ** 3, 10 ** 4, 10 ** 13, 10 ** 15], 12345
    want = [1 + 10 ** 9 * (a + 2) // (b + 2 * terms) for a, b in zip(n, total)]
    assert divergence.shares(np.array(n), np.array(total), terms).tolist() == want
    df = spark.createDataFrame(list(zip(n, total)), "n long, total long")
    assert [int(r[0]) for r in df.select(divergence.share(F.col("n"), F.col("total"), F.lit(terms))).collect()] == want


def test_native_plan_has_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for part in (exact_dedup.normalised(F.col("text")), exact_dedup.blocks(F.col("text").cast("binary"), 8)):
        assert "Python" not in df.select(part)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["op12_divergence", "op13_exact_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
