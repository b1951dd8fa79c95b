"""Language of a text: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import settled
from tideline.llm.tokens import slices

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Words whose scores a worker remembers; beyond it the memory is emptied.
REMEMBERED = 200_000
#: Sampled documents of a language, whatever the number of languages.
LEAST_EACH = 100


def text_words(text: str) -> list[str]:
    return LETTERS.findall(unicodedata.normalize("NFC", text).lower())


def grams(word: str, n: int) -> list[str]:
    edged = f"<{word}>"
    return [edged[i:i + n] for i in range(len(edged) - n + 1)]


@dataclass
class Terms:
    """Log frequencies by language: a row of ``table`` for each known term."""

    at: dict[str, int]
    table: np.ndarray


@dataclass
class Model:
    """Known words and, by length, n-grams."""

    langs: list[str]
    words: Terms
    grams: dict[int, Terms]
    at: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def scores(self, words: list[str]) -> np.ndarray:
        """For each word a known word's log frequencies, or the mean of its longest known n-grams', or nothing."""
        out = np.zeros((len(words), len(self.langs)))

        def put(rows: list[int], found: np.ndarray) -> None:
            out[rows] = found - (found.sum(1) / len(self.langs))[:, None]

        known = [(i, self.words.at[w]) for i, w in enumerate(words) if w in self.words.at]
        if known:
            rows, hits = map(list, zip(*known))
            put(rows, self.words.table[hits])
        left = [i for i, w in enumerate(words) if w not in self.words.at]
        for n in sorted(self.grams, reverse=True):
            at, rows, starts, hits, others = self.grams[n].at, [], [], [], []
            for i in left:
                mine = [at[x] for x in grams(words[i], n) if x in at]
                if mine:
                    rows.append(i)
                    starts.append(len(hits))
                    hits += mine
                else:
                    others.append(i)
            if rows:
                sizes = np.diff([*starts, len(hits)]).astype(np.float32)
                put(rows, np.add.reduceat(self.grams[n].table[hits], starts) / sizes[:, None])
            left = others
        return out

    def word(self, word: str) -> np.ndarray:
        return self.scores([word])[0]

    def forget(self) -> None:
        """Give the memory of words back."""
        self.at, self.rows = {}, None

    def predict(self, text: str | None) -> tuple[str, float]:
        words = text_words(text) if text else []
        if not words or not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if self.rows is None or len(self.at) > REMEMBERED:
            self.at, self.rows = {}, np.zeros((REMEMBERED, len(self.langs)))
        at = self.at
        new = list(set(words).difference(at))
        n = len(at)
        while n + len(new) > len(self.rows):  # one text with more words than are remembered
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[n:n + len(new)] = self.scores(new)
        at.update(zip(new, range(n, n + len(new))))
        total = self.rows[list(map(at.__getitem__, words))].sum(0)
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return self.langs[best], float(odds[best] / odds.sum())


def _log_frequencies(rows, langs: list[str]) -> Terms:
    at = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(rows), len(langs)))
    for i, r in enumerate(rows):
        for x in r["counts"]:
            counts[i, at[x["lang"]]] = x["n"]
    table = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts)))
    return Terms({r["term"]: i for i, r in enumerate(rows)}, table.astype(np.float32))


def fit(labelled: DataFrame, sample: int = 6_000, most: int = 30_000, orders: tuple[int, ...] = (5, 4, 3, 2, 1),
        ) -> Model:
    """Learn from ``text`` and ``lang``; rows where either is null are left out.

    Fitted on about ``sample`` documents chosen by hash, as many of each language (all of a language
    that has fewer), so that the model stays small enough for every worker: ``most`` words and as
    many n-grams of each length, an equal number for each language, those most frequent in it first.
    With more languages than ``sample`` / :data:`LEAST_EACH` the sample grows. No labelled row gives a
    model that answers ``und``.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(sample // max(len(sizes), 1), LEAST_EACH)
    grain = 1 << 40
    # One entry per language; the seed of the hash is the text too, as ids may be null or repeat.
    shares = {lang: max(1, int(grain * each / n)) for lang, n in sizes.items() if n > each}
    if shares:
        chosen = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
        slot = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(grain))
        rows = rows.where(slot < F.coalesce(F.try_element_at(chosen, F.col("lang")), F.lit(grain)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found: Counter = Counter()
                for _, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                    for word, n in Counter(text_words(text)).items():
                        found[lang, word] += n
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k[0] for k in found]), pa.array([k[1] for k in found]),
                         pa.array(list(found.values()), pa.int64())], names=["lang", "term", "n"])

    seen = settled(rows.mapInArrow(count, "lang string, term string, n long")
                   .groupBy("lang", "term").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in seen.select("lang").distinct().collect())
    quota = max(most // max(len(langs), 1), 1)

    def top(terms: DataFrame, least: int) -> Terms:
        counted = terms.groupBy("term").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("counts"))
        counted = settled(counted.where(F.col("all") >= least))
        named = counted.select("term", F.explode("counts").alias("x")).select("term", "x.lang", "x.n")
        # Only ``quota`` terms of a language leave a task.
        best = [named.where(F.col("lang") == lang).orderBy(F.desc("n"), "term").limit(quota).select("term") for lang in langs]
        picked = reduce(DataFrame.unionByName, best, terms.select("term").limit(0)).distinct()
        return _log_frequencies(counted.join(picked, "term", "left_semi").orderBy(F.desc("all"), "term").collect(), langs)

    def cut(n: int) -> DataFrame:
        edged = F.concat(F.lit("<"), "term", F.lit(">"))
        pieces = F.transform(F.sequence(F.lit(1), F.length(edged) - n + 1), lambda i: F.substr(edged, i, F.lit(n)))
        return (seen.where(F.length(edged) >= n).select("lang", F.explode(pieces).alias("term"), "n")
                .groupBy("lang", "term").agg(F.sum("n").alias("n")))

    return Model(langs, top(seen, 3), {n: top(cut(n), 2) for n in orders})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the posterior, equal priors) from ``text`` alone.

    Null, empty and letterless texts get ``und`` and 0. Of equal languages the first by code point
    wins. Rows stay where they are, repeated ones too; other columns are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in parts:
            yield pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score"])
        shared.value.forget()  # the worker may wait long for its next task

    out = docs.withColumn("_language", predict(F.col("text").cast("string")))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return out.select(*kept, "_language.lang_pred", "_language.score")
