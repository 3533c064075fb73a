"""Hashed features of texts and small linear models, fitted on the driver from bounded samples."""

from __future__ import annotations

import re

import numpy as np

_WORD = re.compile(r"[^\W\d_]+")


def mix(h: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of a product: a slot for each hash."""
    return (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def gram_counts(texts: list[str | None], orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of hashed byte n-grams of the lower-cased letters and spaces of whole texts, a row for each text.

    Digits, signs and line ends are one space, so that lists, markup and junk marks say nothing.
    """
    out = np.zeros((len(texts), len(orders) << bits), np.float32)
    for row, t in enumerate(texts):
        if not t:
            continue
        clean = " " + " ".join(_WORD.findall(t.lower())) + " "
        b = np.frombuffer(clean.encode(), np.uint8).astype(np.uint64)
        for k, n in enumerate(orders):
            if len(b) < n:
                continue
            h = b[: len(b) - n + 1].copy()
            for j in range(1, n):
                h = h << np.uint64(8) | b[j : len(b) - n + 1 + j]
            out[row, k << bits : (k + 1) << bits] = np.bincount(mix(h + np.uint64(1), bits), minlength=1 << bits)
    return out


def scaled_rows(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, each row of length one; empty rows stay zero."""
    x = np.sqrt(counts)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def logistic(x: np.ndarray, y: np.ndarray, *, rounds: int = 150, rate: float = 8.0, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent with momentum; y may be soft labels from 0 to 1."""
    w, b, mw, mb = np.zeros(x.shape[1], np.float32), 0.0, 0.0, 0.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y).astype(np.float32)
        mw = 0.9 * mw + (x.T @ g / len(y) + ridge * w)
        mb = 0.9 * mb + g.mean()
        w, b = w - rate * mw * 0.1, b - rate * float(mb) * 0.1
    return w.astype(np.float32), b


class SparseRows:
    """Rows of few features: products with weights, and of the rows' values with the features."""

    def __init__(self, rows: list[dict[int, float]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)
        self.value = np.array([v for r in rows for v in r.values()], float)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], self.width)


def cumulative_link(x: SparseRows, target: np.ndarray, weight: np.ndarray, *, lasso: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights shared by all thresholds, and the thresholds, of P(grade >= j) = sigmoid(w.x - b_j); target has a
    column of 0 and 1 for each threshold. Accelerated proximal gradient; weight 0 leaves a row out."""
    cuts = 2.0 + np.arange(target.shape[1])
    w = np.zeros(x.width)
    v, step = np.random.default_rng(0).normal(size=x.width), 1.0
    for _ in range(30 if x.width else 0):  # the step follows from the features' largest joint strength
        v = x.back(weight * x.dot(v))
        step = np.linalg.norm(v)
        v /= max(step, 1e-12)
    step = 1 / (0.25 * target.shape[1] * max(step, 1e-9) / x.n)
    ahead, last, t = w, w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.dot(ahead)[:, None] - cuts[None], -30, 30)))
        g = (p - target) * weight[:, None]
        w = ahead - step * x.back(g.sum(1)) / x.n
        w = np.sign(w) * np.maximum(np.abs(w) - step * lasso, 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, last, t = w + (t - 1) / u * (w - last), w, u
        cuts = np.maximum.accumulate(cuts + 0.5 * g.mean(0))  # ordered thresholds
    return w, cuts
