"""Neighbours, embedding near-dedup, packing, mixing and token files."""

import contextlib
import math
import os
import random
import threading
import zlib
from collections import Counter, defaultdict
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import ann, embedding_dedup, mixing, packing, token_files, tokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>"
ODD = [(9000, None), (9050, [0.0] * 16), (9100, [math.nan] + [1.0] * 15), (9150, [None] + [1.0] * 15),
       (9200, [math.inf] + [1.0] * 15), (9250, [])]


def cosines(x):
    x = x.astype(np.float32).astype(float)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    return np.einsum("id,jd->ij", u, u)


def test_neighbours_are_found_and_copies_come_by_id(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    x[300:420] = x[300]  # a large group of equal vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + ODD, VECTORS)
    got = defaultdict(list)
    for r in ann.search(df, every=50, k=5, shard_size=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    c = cosines(x)
    hits = 0
    assert set(got) == set(range(0, 900, 50))
    for q, found in got.items():
        near = sorted((i for i in range(900) if i != q), key=lambda i: (-round(c[q, i], 12), i))[:5]
        hits += len(set(near) & {i for i, _ in found})
        assert all(abs(s - c[q, i]) < 1e-9 for i, s in found) and len(found) == 5
    assert [i for i, _ in got[300]] == [301, 302, 303, 304, 305]
    assert [i for i, _ in got[350]] == [300, 301, 302, 303, 304]
    assert hits / (5 * len(got)) >= 0.9
    assert ann.search(df.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0, 1.0])], VECTORS)
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(few).collect()] == [(0, 1, 0.0)]


def test_near_equal_vectors_are_grouped(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16))
    for i in range(0, 300):
        x[i + 300] = x[i // 10 * 10] + rng.normal(size=16) * 0.12
    x[650:680] = x[5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + ODD, VECTORS)
    c = cosines(x) >= 0.9
    root = list(range(700))
    for a, b in zip(*np.nonzero(c)):
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in
           embedding_dedup.dedup(df, cell_size=60, block=64).collect()}
    assert got == {i: (int(c[i].sum()) - 1, root[i], root[i] == i) for i in range(700)} | {
        i: (0, i, True) for i, _ in ODD}
    assert embedding_dedup.dedup(df.limit(0)).collect() == []


def test_a_large_group_of_near_copies_over_many_cells_loses_no_link(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 16))
    x[:300] = x[0] + rng.normal(size=(300, 16)) * np.sqrt((x[0] ** 2).mean()) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    c = cosines(x) >= 0.9
    links = {r.vec_id: r.n_links for r in embedding_dedup.dedup(df, cell_size=15, block=256).collect()}  # 60 cells
    assert links == {i: int(c[i].sum()) - 1 for i in range(900)}


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=25))
def test_plans_meet_every_demand(histogram):
    made = Counter()
    for pattern, times in packing.plan(histogram, 40):
        assert sum(w * n for w, n in pattern) <= 40
        for w, n in pattern:
            made[w] += n * times
    assert made == Counter({w: n for w, n in histogram.items() if n})


def test_packing_places_each_piece_once(spark):
    rng = random.Random(6)
    rows = [(i, 0, rng.choice([3, 17, 64, 64, 64, 200, 256])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, start long, length long")
    got = packing.pack(df, ["doc_id", "start"], capacity=256, grain=8).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter((i, n) for i, _, n in rows)
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    widths = Counter(-(-n // 8) for *_, n in rows)
    _, best = packing.column_generation(np.array(sorted(widths)), np.array([widths[w] for w in sorted(widths)], float), 32)
    assert len(used) <= best.sum() + len(widths)  # the fractional optimum, and what rounding may add
    assert packing.pack(df.limit(0), ["doc_id", "start"]).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, ["doc_id", "start"], capacity=128)


def test_packing_goes_on_where_names_clash(spark):
    names = ["sequence_id", "Offset", "slot", "place", "row", "width", "one", "rank", "key0", "filled",
             "_range", "_sum", "_base", "_width", "_rank", "a.b"]
    rows = [(i % 5, i, 1 + i * 7 % 64) for i in range(60)] + [(None, 1, 9), (None, 1, 9)]
    plain = spark.createDataFrame(rows, "doc_id long, start long, length long")
    df = plain.select("*", *[F.concat(F.lit(n), "start").alias(n) for n in names])
    got = packing.pack(df, ["doc_id", "start"], capacity=64, grain=8)
    kept = [n for n in names if n not in ("sequence_id", "Offset")]
    assert got.columns == ["doc_id", "start", "length", *kept, "sequence_id", "offset"]
    want = packing.pack(plain, ["doc_id", "start"], capacity=64, grain=8)
    place = lambda r: (r["doc_id"] is None, r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"])
    found = got.collect()
    assert sorted(map(str, map(place, found))) == sorted(map(str, map(place, want.collect())))
    assert all(r[n] == f"{n}{r['start']}" for r in found for n in kept)


def test_an_id_on_several_vectors_joins_none_of_them(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [0.0, 1.0], "y"), (2, [1.0, 0.01], "z"), (3, [0.01, 1.0], "z"),
            (3, [0.01, 1.0], "z"), (0, [-1.0, 0.0], "z"), (None, [1.0, 0.0], "z"), (2, None, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string").withColumns(
        {n: F.lit(9) for n in ("least", "copies", "component", "component_id", "n_links", "kept", "cell", "x")})
    got = sorted(map(tuple, embedding_dedup.dedup(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False),
                          (0, 0, 0, True), (None, 0, None, True), (2, 0, 2, True)], key=str)


def test_scaled_copies_tie_with_equal_ones(spark):
    v = [0.1, 0.7, 0.3, 0.9, 0.2, 0.6]
    rows = [(50, v), (7, [4 * c for c in v]), (60, v), (3, [c / 2 for c in v]), (9, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {n: F.lit("x") for n in ("rep", "place", "salt", "shard", "score", "rank", "query")})
    got = ann.search(df).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 7, 60, 9] and len({r.score for r in got[:3]}) == 1


def test_pieces_hold_all_ids(spark):
    texts = [None, "", "word " * 3000, "Ünïcode ßtraße 漢字 🙂 <|endoftext|> it's 42", "a\tb\r\nc"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    whole = defaultdict(dict)
    for r in tokens.pieces(df, VOCABULARY, end_id=1, longest=256).collect():
        assert r.length == len(r.ids) // 4 <= 256
        whole[r.doc_id][r.start] = bytes(r.ids)
    for i, t in enumerate(texts):
        want = tokens.encoder(VOCABULARY).tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(whole[i][k] for k in sorted(whole[i])), "<u4").tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZé'sTß İı\n\t.<|>0²́"), st.characters()), max_size=40))
def test_chunks_encode_as_the_whole_text(text):
    encode = tokens.encoder(VOCABULARY)
    text = text.encode("utf-8", "ignore").decode()
    want = encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == want


def test_what_is_asked_for_again_is_not_encoded_again(monkeypatch):
    asked = []

    class Counted(tokens.Encoder):
        def word(self, word):
            asked.append(word)
            return super().word(word)

    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    encode = Counted(VOCABULARY)
    texts = [f"the House, {' '.join(f'w{chr(97 + i)}{chr(97 + k)}{chr(97 + k // 26)}' for k in range(300))}" for i in range(20)]
    want = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(encode([t])[0], "<u4").tolist() for t in texts] == want
    assert asked.count("the") == asked.count("house") == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 2**32 - 1), st.just(7)), max_size=700),
       st.integers(0, 700), st.integers(0, 700))
def test_blocks_come_back(ids, low, high):
    ids = np.array(ids, np.uint32)
    data = token_files.encode_segment(3, 4, [5], [ids])
    (head, view), = token_files.segments(data + b"\n")
    assert head[2:4] == (3, 4) and (token_files.segment_ids(head, view) == ids).all()
    assert (token_files.segment_ids(head, view, low, high) == ids[low:max(low, high)]).all()


def test_token_files_read_back_in_order(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma.", "x"]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(300, None), (301, ""), (7, "again"), (None, "no id")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    token_files.write(df, str(tmp_path / "t"), VOCABULARY, end_id=2)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids)))
           for r in token_files.read(spark, str(tmp_path / "t")).orderBy("start").collect()]
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokens.encoder(VOCABULARY).tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def fill(sizes, weights, share, most):
    """Targets of sources in order, by raising a common level until all is given."""
    total, target = share * sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] >= most * sizes[i]}
        for i in open_:
            target[i] = most * sizes[i] if i in full else level * weights[i]
        open_ -= full
        if not full:
            break
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(8)
    plan = {"a": 400, "b": 900, "c": 30, "é": 500, None: 300}
    rows, sizes = [], Counter()
    for source, n in plan.items():
        for _ in range(n):
            size = rng.choice([0, 1, 5, 20, 80])
            rows.append((len(rows), " ".join(["w"] * size) if size else rng.choice([None, "", " "]), source))
            sizes[source] += size
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, rate int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    want = dict(zip(plan, fill([sizes[s] for s in plan], [5, 2, 1, 5, 2], 1.5, 2)))
    taken = Counter()
    for r in got:
        taken[r.source] += r.copies * r.size
        assert 0 <= r.copies <= 2 and r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for source in plan:
        assert abs(taken[source] - want[source]) <= 161
    again = {r.doc_id: r.copies for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    assert mixing.mix(df.limit(0)).collect() == []


def test_blocks_of_queries_are_never_broadcast(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], VECTORS)
    found = ann.search(df, every=4, k=3, shard_size=50, block=16)  # 8 shards, 7 blocks
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line or "Exchange " in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            assert "MapInArrow find" in "".join(lines[i:below]) or "asked" not in "".join(lines[i:below])
    assert any("CartesianProduct" in line for line in lines)
    x = cosines(np.array([r.embedding for r in df.orderBy("vec_id").collect()]))
    got = {(r.query_id, r.rank): r.score for r in found.collect()}
    assert len(got) == 300
    assert all(abs(got[q, 1] - max(c for j, c in enumerate(x[q]) if j != q)) < 1e-9 for q in range(0, 400, 4))


@contextmanager
def most_shuffled(spark):
    """The most bytes that lay in Spark's local folders meanwhile, as a list of one."""
    folders = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def there():
        total = 0
        for top in folders:
            for d, _, names in os.walk(top):
                for name in names:
                    with contextlib.suppress(OSError):  # files come and go
                        total += os.stat(f"{d}/{name}").st_size
        return total

    most, over, before = [0], threading.Event(), there()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], there() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        yield most
    finally:
        over.set()
        watcher.join()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_without_clusters_are_not_copied_for_each_other(spark, kind):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(2400, 24)).astype(np.float32)
    x[:200] = x[300] + rng.normal(size=(200, 24)) * 0.3
    x[2000:2300, 3] = 0.0
    x[2100:2300] = x[2000:2200] * np.where(np.arange(24) == 3, -1, 1)  # -0.0 is 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    with most_shuffled(spark) as most:
        got = {r.vec_id: r.n_links for r in embedding_dedup.dedup(df, cell_size=24, block=64).collect()}  # 100 cells
    assert most[0] < 12 * x.nbytes
    c = cosines(x) >= 0.9
    assert got == {i: int(c[i].sum()) - 1 for i in range(2400)}


def test_vectors_that_share_a_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "digest", lambda vector: F.pmod(F.xxhash64(vector), F.lit(150)))
    rng = np.random.default_rng(15)
    x = rng.normal(size=(200, 8))
    x[150:] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + ODD, VECTORS)
    c = cosines(x) >= 0.9
    got = {r.vec_id: r.n_links for r in embedding_dedup.dedup(df).collect()}
    assert got == {i: int(c[i].sum()) - 1 for i in range(200)} | {i: 0 for i, _ in ODD}
