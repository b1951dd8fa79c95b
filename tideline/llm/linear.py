"""Sparse logistic regression over a bounded sample, and calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_sparse(rows: list[np.ndarray], target: np.ndarray, features: int, penalty: float = 1.0,
               turns: int = 12, inner: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias for binary features; ``rows`` lists the features each row has, ``target`` may be soft.

    Newton steps on the penalised likelihood, each solved by conjugate gradients and halved
    until it improves.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    shrink = np.r_[np.full(features, penalty), 1e-3]

    def times(w):
        return np.bincount(at, w[which], len(rows)) + w[-1]

    def back(v):
        return np.r_[np.bincount(which, v[at], features), v.sum()]

    def loss(w):
        z = times(w)
        return (np.logaddexp(0, z) - target * z).sum() + (shrink * w * w).sum() / 2

    w = np.zeros(features + 1)
    now = loss(w)
    for _ in range(turns):
        p = sigmoid(times(w))
        curve = np.maximum(p * (1 - p), 1e-6)
        r = -(back(p - target) + shrink * w)
        step, d, size = np.zeros_like(w), r.copy(), (r * r).sum()
        goal = size * 1e-6
        for _ in range(inner):
            if size <= goal:
                break
            hd = back(curve * times(d)) + shrink * d
            alpha = size / (d * hd).sum()
            step += alpha * d
            r = r - alpha * hd
            size, old = (r * r).sum(), size
            d = r + size / old * d
        part = 1.0
        while part > 1e-3 and (then := loss(w + part * step)) > now:
            part /= 2
        if part <= 1e-3 or now - then < 1e-6 * now:
            break
        w, now = w + part * step, then
    return w[:-1], float(w[-1])


def fit_dense(x: np.ndarray, target: np.ndarray, penalty: float = 1e-3, turns: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias for standardised dense features."""
    w, bias = np.zeros(x.shape[1]), 0.0
    step = 1.0 / (0.25 * max(1.0, float((x ** 2).sum(1).mean())) + penalty) if len(x) else 0.0
    for _ in range(turns if len(x) else 0):
        over = sigmoid((x * w).sum(1) + bias) - target
        w -= step * ((x * over[:, None]).mean(0) + penalty * w)
        bias -= step * over.mean()
    return w, float(bias)


def calibrate(logit: np.ndarray, target: np.ndarray, turns: int = 50) -> tuple[float, float]:
    """Platt scaling: slope (not negative) and offset, by Newton steps with a little smoothing."""
    if len(logit) < 10 or target.min() == target.max():
        return 1.0, 0.0
    n1, n0 = (target > 0.5).sum(), (target <= 0.5).sum()
    goal = np.where(target > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(turns):
        p = sigmoid(a * logit + b)
        s = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - goal) * logit).sum() + 1e-3 * (a - 1), (p - goal).sum()
        haa, hab, hbb = (s * logit ** 2).sum() + 1e-3, (s * logit).sum(), s.sum() + 1e-9
        det = haa * hbb - hab ** 2
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -2, 2)
    return float(max(a, 0.0)), float(b)
