"""Quality by co-training: a view of the text and a view of the metadata teach each other."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import settled
from tideline.llm.linear import calibrate, fit_dense, sigmoid

SYMBOL = re.compile(r"[^\w\s.,;:'’\"()!?-]")
TEXT_FEATURES = 12
META_FEATURES = 8


def text_features(text: str | None) -> list[float]:
    """Form of the whole text: repetition, symbols, capitals, punctuation, word and line lengths."""
    words = text.split() if text else []
    if not words:
        return [0.0] * (TEXT_FEATURES - 1) + [1.0]
    n, chars = len(words), sum(map(len, words))
    counts = Counter(words)
    lines = text.split("\n")
    pairs = sum(a == b for a, b in zip(words, words[1:]))
    ends = text.count(".")
    capitals = sum(map(str.isupper, words))
    return [
        len(counts) / n, max(counts.values()) / n, pairs / n,
        len(SYMBOL.findall(text)) / n, capitals / n, text.count("!") / n, text.count("|") / n,
        ends / n, chars / n / 10, np.log1p(n) / 10, 1 - len(set(lines)) / len(lines), 0.0]


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """What is known without the text: source and language by hash, length by record."""
    def slot(value: str | None, n: int) -> list[float]:
        out = [0.0] * n
        if value is not None:
            out[sum(value.encode("utf-8", "surrogatepass")) % n] = 1.0
        return out

    long = np.log1p(max(n_chars or 0, 0)) / 10
    return [*slot(source, 2), *slot(lang, 3), long, long ** 2, float(n_chars is None)]


@dataclass
class View:
    """A calibrated linear classifier over standardised features, and how much it can be trusted."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    trust: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (((x - self.mean) / self.scale) * self.weights).sum(1) + self.slope * self.bias + self.offset


def _with_squares(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.abs(x))])


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(0), x.std(0) + 1e-3
    weights, bias = fit_dense((x - mean) / scale, y)
    return View(mean, scale, weights, bias)


def _auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n1, n0 = y.sum(), (1 - y).sum()
    return float((order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else 0.5


def cotrain(views: list[np.ndarray], gold: np.ndarray, rounds: int, share: float) -> list[View]:
    """Fit one classifier for each view.

    ``gold`` is 1, 0, or -1 where it is not known. A fifth of the known rows of each kind is kept aside for calibration. In each
    round either view labels, of the rows not known to the other, the ``share`` it is surest of on
    both sides, in the proportion of the labels; the other learns from them in the next round.
    """
    known = np.flatnonzero(gold >= 0)
    aside = np.concatenate([np.flatnonzero(gold == kind)[4::5] for kind in (0, 1)])
    base = np.where(np.isin(np.arange(len(gold)), aside), -1, gold)
    taught = [base.astype(float), base.astype(float)]
    good = float(np.mean(gold[known])) if len(known) else 0.5
    fitted = [fit_view(x[t >= 0], t[t >= 0]) for x, t in zip(views, taught)]
    pool = gold < 0
    for _ in range(rounds):
        logits = [f.logit(x) for f, x in zip(fitted, views)]
        for me in (0, 1):
            free = np.flatnonzero(pool & (taught[1 - me] < 0))
            order = free[np.argsort(logits[me][free], kind="stable")]
            take = int(share * len(free))
            low, high = order[:int(take * (1 - good))], order[len(order) - int(take * good):]
            sure = np.abs(logits[me]) > np.log(9)
            taught[1 - me][low[sure[low] & (logits[me][low] < 0)]] = 0
            taught[1 - me][high[sure[high] & (logits[me][high] > 0)]] = 1
        fitted = [fit_view(x[t >= 0], t[t >= 0]) for x, t in zip(views, taught)]
    for f, x in zip(fitted, views):
        raw = f.logit(x[aside])
        f.slope, f.offset = calibrate(raw, gold[aside])
        f.trust = max(0.0, 2 * _auc(raw, gold[aside]) - 1)
    return fitted


@dataclass
class Model:
    views: list[View]
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Calibrated log odds of both views over the prior, weighted by trust, as a probability."""
        total = np.full(len(text), self.prior)
        for view, x in zip(self.views, (text, meta)):
            total = total + view.trust * (view.logit(_with_squares(x)) - self.prior)
        return sigmoid(total)


def _features(text, source, lang, n_chars) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([text_features(t) for t in text], float).reshape(-1, TEXT_FEATURES)
    b = np.array([meta_features(s, g, None if pd.isna(n) else int(n)) for s, g, n in zip(source, lang, n_chars)],
                 float).reshape(-1, META_FEATURES)
    return a, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, rounds: int = 5, share: float = 0.1) -> Model:
    """Learn from ``docs`` (``doc_id``, ``text``, ``source``, ``lang``, ``n_chars``) and ``quality`` of ``labels``.

    Fitted on about ``sample`` labelled and as many other documents, chosen by hash (all, if there are
    fewer); null labels are left out, of repeated ones the largest counts. Labels of one kind
    alone, or none, give a model that scores all documents alike.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    grain = 1 << 20
    slot = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(grain))
    n_known, n_docs = known.count(), docs.count()
    chosen = known.where(slot < grain * min(1.0, sample / max(n_known, 1)))
    # About ``sample`` rows, by the filter above: texts that are not chosen stay where they are.
    joined = docs.join(F.broadcast(chosen), "doc_id", "left").where(
        F.col("quality").isNotNull() | (slot < grain * min(1.0, sample / max(n_docs, 1))))

    @F.pandas_udf("text array<double>, meta array<double>")
    def features(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        a, b = _features(text, source, lang, n_chars)
        return pd.DataFrame({"text": list(a), "meta": list(b)})

    # Bounded by ``sample``: two dozen numbers for each row.
    rows = settled(joined.select("doc_id", F.col("quality").cast("int").alias("quality"), features(
        F.col("text").cast("string"), "source", "lang", "n_chars").alias("f"))).orderBy("doc_id").collect()
    gold = np.array([-1 if r["quality"] is None else r["quality"] for r in rows])
    if not (gold == 1).any() or not (gold == 0).any():
        flat = [View(np.zeros(2 * n), np.ones(2 * n), np.zeros(2 * n), 0.0) for n in (TEXT_FEATURES, META_FEATURES)]
        return Model(flat, 0.0)
    text, meta = (np.array([r["f"][i] for r in rows]) for i in (0, 1))
    p = float(np.clip(gold[gold >= 0].mean(), 0.01, 0.99))
    return Model(cotrain([_with_squares(text), _with_squares(meta)], gold, rounds, share), float(np.log(p / (1 - p))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score``, how likely the document is good, from all columns of both views; nulls count as empty.

    Rows stay where they are, repeated ones too; other columns are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(*_features(text, source, lang, n_chars)), dtype=float)

    return docs.withColumn("score", rate(F.col("text").cast("string"), "source", "lang", "n_chars"))
