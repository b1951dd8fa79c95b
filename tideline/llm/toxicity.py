"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import settled
from tideline.llm.linear import fit_sparse, sigmoid
from tideline.llm.tokens import slices

LETTERS = re.compile(r"[^\W\d_]+")
#: Voters that look at form, not words. Their accuracy is estimated like any other's.
PATTERNS = {
    "~shout": re.compile(r"\b[A-Z]{4,}\b.{0,3}!"),
    "~marks": re.compile(r"[!?]{2,}"),
    "~stretch": re.compile(r"([^\W\d_])\1{3,}"),
    "~censored": re.compile(r"[^\W\d_][*@#$]{2,}"),
}
#: Lengths of the word beginnings that count as terms beside whole words.
STEMS = (4, 5, 6)
REMEMBERED = 60_000


def word_terms(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}-" for n in STEMS if len(word) > n))


def text_terms(text: str | None) -> set[str]:
    """Distinct words, word beginnings and patterns of a whole text."""
    if not text:
        return set()
    found = {p for p, rule in PATTERNS.items() if rule.search(text)}
    for word in set(LETTERS.findall(unicodedata.normalize("NFC", text).lower())):
        found.update(word_terms(word))
    return found


@dataclass
class Model:
    """A linear classifier over the presence of terms."""

    at: dict[str, int]
    weights: np.ndarray
    bias: float
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        hits = {self.at[p] for p, rule in PATTERNS.items() if p in self.at and text and rule.search(text)}
        if text:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for word in set(LETTERS.findall(unicodedata.normalize("NFC", text).lower())):
                mine = self.known.get(word)
                if mine is None:
                    mine = self.known[word] = tuple(self.at[t] for t in word_terms(word) if t in self.at)
                hits.update(mine)
        return float(sigmoid(self.weights[sorted(hits)].sum() + self.bias))


def label_model(votes: np.ndarray, gold: np.ndarray, toxic_first: np.ndarray, turns: int = 25) -> np.ndarray:
    """Posterior of the label of each row, from which voters fire (rows x voters, boolean).

    EM over the accuracy of each voter: how often it fires on toxic and on other rows. A voter
    that does not fire abstains, as a toxic text holds few of many toxic words; that none of them
    fires is one more vote. Voters
    that fire together more than their accuracies explain share their weight: each counts as
    one over one plus its positive correlations. ``gold`` is 1, 0, or -1 where it is not known:
    a label is one more vote, for or against, whose accuracy is estimated like the others'.
    ``toxic_first`` is the first guess where there is no label.
    """
    fires = np.c_[votes, ~votes.any(1)].astype(np.float64)
    known, says = gold >= 0, gold == 1
    posterior = np.where(known, np.clip(gold, 0.02, 0.98), toxic_first)
    share = np.ones(fires.shape[1])
    for turn in range(turns):
        p = posterior
        on1 = ((fires * p[:, None]).sum(0) + 0.05) / (p.sum() + 1)
        on0 = ((fires * (1 - p)[:, None]).sum(0) + 0.05) / ((1 - p).sum() + 1)
        prior = (p.sum() + 1) / (len(p) + 2)
        if turn in (5, 12):  # what accuracies don't explain is correlation
            rest = fires - (p[:, None] * on1 + (1 - p)[:, None] * on0)
            rest /= np.sqrt((rest ** 2).mean(0) + 1e-9)
            both = np.einsum("ij,ik->jk", rest, rest) / len(rest)
            np.fill_diagonal(both, 0)
            share = 1 / (1 + np.where(both > 0.25, both, 0).sum(0))
        said1 = (p[says].sum() + 0.5) / (p[known].sum() + 1)
        said0 = ((1 - p)[says].sum() + 0.5) / ((1 - p)[known].sum() + 1)
        label = np.where(says, np.log(said1 / said0), np.where(known, np.log((1 - said1) / (1 - said0)), 0))
        odds = np.log(prior / (1 - prior)) + (fires * (share * np.log(on1 / on0))).sum(1) + label
        posterior = sigmoid(odds)
    return posterior


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, voters: int = 300, features: int = 4_000,
        least: int = 3) -> Model:
    """Learn from ``docs`` (``doc_id``, ``text``) and the ``toxic`` column of ``labels`` (``doc_id``).

    Fitted on about ``sample`` labelled and a quarter as many other documents, chosen by hash (all,
    if there are fewer). Voters are the terms seen in at least ``least`` toxic documents that best
    tell toxic documents apart, ``voters`` at most, and the patterns; the classifier has at most
    ``features`` terms. Null labels are left out; of repeated labels the largest counts. Without a
    toxic label every score is low.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    grain = 1 << 20
    slot = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(grain))
    n_known, n_docs = known.count(), docs.count()
    chosen = known.where(slot < grain * min(1.0, sample / max(n_known, 1)))
    # About ``sample`` rows, by the filter above: texts that are not chosen stay where they are.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").where(
        F.col("toxic").isNotNull() | (slot < grain * min(1.0, sample / 4 / max(n_docs, 1))))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                _, texts, toxic = (c.to_pylist() for c in batch.columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sorted(text_terms(t)) for t in texts], pa.list_(pa.string())),
                     pa.array(toxic, pa.int32())], names=["terms", "toxic"])

    rows = settled(joined.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
                   .mapInArrow(terms, "terms array<string>, toxic int"))
    n1, n0 = rows.agg(F.sum(F.expr("int(toxic = 1)")), F.sum(F.expr("int(toxic = 0)"))).first()
    n1, n0 = n1 or 0, n0 or 0
    counted = (rows.where("toxic is not null").select(F.explode("terms").alias("term"), "toxic")
               .groupBy("term").agg(F.sum(F.expr("int(toxic = 1)")).alias("a"),
                                    F.sum(F.expr("int(toxic = 0)")).alias("b"))
               .where((F.col("a") >= least) | (F.col("b") >= 4 * least)))
    counted = settled(counted)
    base = n1 / max(n1 + n0, 1)
    n, q = F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    # Log of how unlikely a term's split is by chance; what chance gives once among all terms is no evidence.
    ranked = counted.withColumn("evidence", n * (part(q, F.lit(max(base, 1e-9))) + part(1 - q, F.lit(max(1 - base, 1e-9)))))
    ranked = ranked.where(F.col("evidence") > float(np.log(max(counted.count(), 2))))
    best = [F.desc("evidence"), F.col("term")]
    toxic_terms = [r["term"] for r in ranked.where(q > 2 * base).orderBy(*best).limit(voters).collect()]
    useful = [r["term"] for r in ranked.orderBy(*best).limit(features).collect()]
    lexicon = list(dict.fromkeys([*toxic_terms, *PATTERNS]))
    names = list(dict.fromkeys([*lexicon, *useful]))
    at = {t: i for i, t in enumerate(names)}

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([[at[t] for t in terms if t in at] for terms in batch.column(0).to_pylist()], pa.list_(pa.int32())),
                 batch.column(1)], names=["hits", "toxic"])

    # Bounded: one list of known terms for each row of the sample.
    data = rows.select("terms", "toxic").mapInArrow(known, "hits array<int>, toxic int").toPandas()
    lists = [np.sort(np.array(h if isinstance(h, (list, np.ndarray)) else [], np.int64)) for h in data["hits"]]
    gold = data["toxic"].fillna(-1).to_numpy(float)
    votes = np.zeros((len(lists), len(lexicon)), bool)
    for i, h in enumerate(lists):
        votes[i, h[h < len(lexicon)]] = True
    if not len(lists) or not n1:
        return Model(at, np.zeros(len(at)), -5.0)
    first = np.where(votes[:, :len(toxic_terms)].any(1), 0.8, 0.05)
    posterior = label_model(votes, gold, first)
    weights, bias = fit_sparse(lists, posterior, len(at), penalty=0.01)
    return Model(at, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score``, how likely the text is toxic, from ``text`` alone; null and empty texts get the bias.

    Rows stay where they are, repeated ones too; other columns are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in parts:
            yield pd.Series([shared.value.score(t) for t in text], dtype=float)
        shared.value.known.clear()  # the worker may wait long for its next task

    return docs.withColumn("score", rate(F.col("text").cast("string")))
