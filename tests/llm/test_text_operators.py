"""Language, licences, the Jaccard join, toxicity and quality on small texts."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tideline.llm import language, license, ngram_join, quality, toxicity
from tideline.llm.shingles import shingle_sets

WORDS = {"en": "the of and to in that is was for with this from house water".split(),
         "de": "der die und nicht ein wird sich mit haus wasser auch nach bei".split()}


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))


def test_language_backs_off_to_grams_and_leaves_letterless_texts_undetermined(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, 40), lang, "s", 1) for i in range(60) for lang in ("en", "de")]
    rows += [(900, None, "en", None, None), (901, "some text", None, None, None)]
    model = language.fit(documents(spark, rows), orders=(4, 3, 2, 1))
    asked = [(1, "the waters of this house"), (2, "die wassern und das hausen"), (3, None), (4, ""), (5, "123 .. !"),
             (1, "the waters of this house"), (6, "die " * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in asked], "doc_id long, text string, score string")
    got = sorted((r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in language.identify(df, model).collect())
    assert got == [(1, "en", True), (1, "en", True), (2, "de", True), (3, "und", True), (4, "und", True),
                   (5, "und", True), (6, "de", True)]
    assert model.word("wasserhaus")[model.langs.index("de")] > 0  # unseen as a word
    assert language.fit(documents(spark, [])).predict("the") == ("und", 0.0)


def test_words_are_scored_once(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, 40), lang, "s", 1) for i in range(60) for lang in ("en", "de")]
    model = language.fit(documents(spark, rows), orders=(4, 3, 2, 1))
    asked, grams = [], language.grams
    monkeypatch.setattr(language, "grams", lambda word, n: asked.append(word) or grams(word, n))
    texts = [" ".join("".join(chr(97 + n // 26 ** k % 26) for k in range(4)) for n in range(at, at + 10_000)) for at in range(0, 70_000, 10_000)]
    first = [model.predict(t) for t in texts]
    asked.clear()
    assert [model.predict(t) for t in texts] == first and not asked
    alone = np.array([model.word(w) for w in texts[0].split()[:50]])
    assert np.allclose(alone, model.scores(texts[0].split()[:50]), atol=1e-6)


def test_a_rare_language_is_learned_beside_frequent_ones(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, "en" if i % 2 else "de", 20), "en" if i % 2 else "de", "s", 1) for i in range(6000)]
    rows += [(9000 + i, "vesi talo on ja " + rng.choice(["kala", "joki"]), "fi", "s", 1) for i in range(5)]
    model = language.fit(documents(spark, rows), sample=300, most=60, orders=(3, 2))
    assert model.langs == ["de", "en", "fi"]
    assert {"vesi", "talo", "ja"} <= set(model.words.at)
    assert model.predict("talo ja vesi")[0] == "fi" and model.predict("the water")[0] == "en"


def brute_scan(text, notices, least):
    def norm(t):
        t = re.sub("[^a-z0-9\n]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        return re.sub(" *\n *", "\n", t)

    def grams(unit):
        words = unit.split(" ")
        return ({f"{a} {b}" for a, b in zip(words, words[1:])} or set(words)), max(unit.count(" "), 1)

    n = norm(text)
    found = {}
    for unit in {u.replace("\n", " ").strip() for u in [*n.split("\n"), *re.split("\n\n+", n), re.sub("\n+", " ", n)]} - {""}:
        g, size = grams(unit)
        best = min(((-2 * len(g & t) / (size + tn), name) for name, (t, tn) in
                    ((k, grams(norm(v).replace("\n", " ").strip())) for k, v in notices.items())))
        if -best[0] >= least:
            d, c = found.get(best[1], (0, 0))
            found[best[1]] = (max(d, -best[0]), c + 1)
    return found


def test_licence_scan_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "no licence here", "MIT", "Released under\nthe MIT License."]
    for name, notice in license.NOTICES.items():
        words = notice.split()
        for cut in (0, 1, 3):
            kept = [w for w in words if cut == 0 or rng.random() > cut / 10]
            texts.append("Before.\n\n" + " ".join(kept).upper() + "\nAfter that." * rng.randint(0, 2))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    notices = spark.createDataFrame(list(license.NOTICES.items()), "license string, notice string")
    got = defaultdict(dict)
    for r in license.scan(df, notices).collect():
        got[r.doc_id][r.license] = (pytest.approx(r.dice), r.n_units)
    for i, t in enumerate(texts):
        assert brute_scan(t or "", license.NOTICES, 0.8) == got[i]
    assert license.scan(df.limit(0), notices).isEmpty()


def test_licences_within_longer_lines_and_wrapped_in_paragraphs_are_found(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{long} {license.NOTICES['GPL-3.0']} {long}"),
            (2, f"{long} {license.NOTICES['BSD-3-Clause'].replace('permitted', 'permitted' + chr(10))} {long}\nmore"),
            (3, f"{long} {license.NOTICES['MIT']} {long} {license.NOTICES['LGPL-3.0']} {long}"),
            (4, long), (5, f"{long} licensed under the terms of {long}"),
            (6, f"{long} is {license.NOTICES['GPL-2.0'][13:]} {license.NOTICES['GPL-3.0']} {long}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    notices = spark.createDataFrame(list(license.NOTICES.items()), "license string, notice string")
    got = sorted((r.doc_id, r.license, r.dice, r.n_units) for r in license.scan(df, notices).collect())
    assert got == [(1, "GPL-3.0", 1.0, 1), (2, "BSD-3-Clause", 1.0, 1), (3, "LGPL-3.0", 1.0, 1), (3, "MIT", 1.0, 1),
                   (6, "GPL-2.0", 2 * 9 / 22, 1), (6, "GPL-3.0", 1.0, 1)]


def brute_sets(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_join(rows):
    sets = {i: brute_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_join_equals_brute_force_on_copies_chains_and_shared_passages(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    passage = [word() for _ in range(60)]
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):  # a large group of near copies
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = word()
        rows.append(" ".join(near).upper() if i % 7 == 0 else " ".join(near))
    chain = [word() for _ in range(80)]
    for i in range(12):  # a chain: each links with the next only
        rows.append(" ".join(chain[3 * i:] + [word() for _ in range(3 * i)]))
    rows += [" ".join(passage + [word() for _ in range(n)]) for n in (5, 10, 40, 80, 200, 200, 200)]
    rows += [" ".join(word() for _ in range(n)) for n in (1, 2, 4, 5, 6, 7, 8, 300)]
    rows += [" ".join(word() for _ in range(8))] * 3 + [None, "", " \t\n", "a b", "A  b", "a b c d e f g h", "a b c d e f g h i"]
    listed = list(enumerate(rows))
    rng.shuffle(listed)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in listed], "doc_id long, text string, n_shingles string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == brute_join(listed)
    assert len({c for _, c in got.values()}) < len(rows) - 60


def test_join_of_empty_and_repeated_rows(spark):
    form = "doc_id long, text string"
    assert ngram_join.join(spark.createDataFrame([], form)).collect() == []
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "x y"), (2, None)], form)
    got = sorted(map(tuple, ngram_join.join(df).collect()), key=str)
    assert got == [(1, 1, 1), (1, 1, 1), (2, 0, 2), (None, 1, 1)]


def test_a_large_group_of_near_copies_is_compared_in_proportion_to_its_members(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 301):  # most link with the base, a quarter with nothing, few with each other
        words = list(base)
        for at in rng.sample(range(150), rng.choice([3, 3, 4, 12])):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    compared, verified = [], ngram_join.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == brute_join(rows)
    assert len({c for _, c in got.values()}) > 50
    assert sum(compared) < 10 * len(rows)


def test_shingles_of_many_texts_equal_those_of_each(spark):
    texts = ["a b c d e f", None, "", "É é Z z", "x " * 50, "one"]
    together = shingle_sets(texts)
    assert [len(s) for s in together] == [len(brute_sets(t)) for t in texts]
    for t, s in zip(texts, together):
        assert (shingle_sets([t])[0] == s).all()


def test_toxicity_finds_lexicon_words_and_leaves_clean_texts_alone(spark):
    rng = random.Random(4)
    bad = ["grumph", "blarg", "snootx"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        words = prose(rng, "en", rng.randint(5, 60)).split()
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 4 != 1:
            labels.append((i, int(toxic)))
    form = "doc_id long, text string"
    known = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, form)
    model = toxicity.fit(docs, known)
    asked = [*rows, (1000, None), (1001, ""), (1001, ""), (1002, "the of " * 20000)]
    got = toxicity.score(spark.createDataFrame(asked, form), model).collect()
    assert len(got) == len(asked)
    for r in got:
        assert (r.score >= 0.7) == bool(r.text and set(r.text.split()) & set(bad)), r
    blank = toxicity.fit(docs, known.where("toxic = 0"))
    assert blank.score("grumph") < 0.1
    assert toxicity.fit(docs.limit(0), known.limit(0)).score(None) < 0.1


def test_quality_views_teach_each_other(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        junk = i % 5 == 0
        text = "BUY!! NOW!! " * 30 if junk and i % 2 else "so so so so " * 30 if junk else prose(rng, "en", 80) + "."
        rows.append((i, text, "en", "shop" if junk else "news", len(text)))
        if i % 3 == 0:
            labels.append((i, int(not junk)))
    rows += [(900, None, None, None, None), (901, "", "xx", "é", -1)]
    docs = documents(spark, rows)
    model = quality.fit(docs, spark.createDataFrame([*labels, (1, None)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 5 != 0) for i in range(500))
    assert len(got) == 502 and all(0 <= s <= 1 for s in got.values())
    flat = quality.fit(docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert quality.score(docs, flat).select("score").distinct().count() == 1
