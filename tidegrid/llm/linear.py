"""Sparse rows and logistic regression in numpy, for models fitted on the driver over bounded samples."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .common import spread


@dataclass
class Rows:
    """Rows of a sparse matrix: row r has columns index[start[r]:start[r + 1]] with those values."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.start) - 1

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> Rows:
        start = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows], dtype=np.int64)])
        none = np.zeros(0)
        return Rows(start, np.concatenate([none.astype(np.int64), *(i for i, _ in rows)]).astype(np.int64), np.concatenate([none, *(v for _, v in rows)]), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.value * w[self.index])])
        return sums[self.start[1:]] - sums[self.start[:-1]]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=self.value * np.repeat(r, np.diff(self.start)), minlength=self.width)

    def take(self, at: np.ndarray) -> Rows:
        size = np.diff(self.start)[at]
        cells = spread(self.start[:-1][at], size)
        return Rows(np.concatenate([[0], np.cumsum(size)]), self.index[cells], self.value[cells], self.width)

    def frequent(self, least: int) -> Rows:
        """Without the columns that fewer than `least` rows have."""
        keep = (np.bincount(self.index, minlength=self.width) >= least)[self.index]
        sizes = np.concatenate([[0], np.cumsum(keep)])
        return Rows(sizes[self.start], self.index[keep], self.value[keep], self.width)

    def with_dense(self, extra: np.ndarray) -> Rows:
        """With dense columns appended at the end."""
        k = extra.shape[1]
        cols = np.arange(self.width, self.width + k)
        return Rows.of([(np.concatenate([self.index[a:b], cols]), np.concatenate([self.value[a:b], e])) for a, b, e in zip(self.start[:-1], self.start[1:], extra)], self.width + k)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Logistic:
    weight: np.ndarray
    bias: float

    def logit(self, x: Rows) -> np.ndarray:
        return x.dot(self.weight) + self.bias


def telling(x: Rows, y: np.ndarray, least: float) -> np.ndarray:
    """Columns whose presence and y have a chi-square of at least `least`."""
    n, n1 = len(x), float(y.sum())
    rows = np.repeat(np.arange(n), np.diff(x.start))
    c = np.bincount(x.index, minlength=x.width).astype(float)
    a = np.bincount(x.index, weights=y[rows], minlength=x.width)
    spread = c * (n - c) * n1 * (n - n1)
    chi = np.where(spread > 0, n * (a * n - c * n1) ** 2 / np.maximum(spread, 1), 0)
    return np.flatnonzero((chi >= least) | (c == n))


def fit(x: Rows, y: np.ndarray, l2: float = 1e-3, steps: int = 150, least: float = 0.0) -> Logistic:
    """L2-regularised logistic regression by accelerated gradient steps over columns that tell (see telling); classes count alike. With one class only: its constant."""
    n = max(1, len(x))
    if not len(x) or y.min() == y.max():
        return Logistic(np.zeros(x.width), 6.0 if len(x) and y[0] else -6.0)
    used = telling(x, y, least) if least else np.unique(x.index)
    place = np.full(x.width, -1)
    place[used] = np.arange(len(used))
    index = place[x.index]
    keep = index >= 0
    full, x = x.width, Rows(np.concatenate([[0], np.cumsum(keep)])[x.start], index[keep], x.value[keep], len(used))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    norms = np.bincount(np.repeat(np.arange(n), np.diff(x.start)), weights=x.value**2, minlength=n)
    step = 1 / (0.25 * (float(np.quantile(norms, 0.95)) + 1) + l2)
    w, b, vw, vb, t = np.zeros(x.width), 0.0, np.zeros(x.width), 0.0, 1.0
    last = np.inf
    for _ in range(steps):
        z = x.dot(vw) + vb
        r = share * (sigmoid(z) - y)
        loss = float((share * np.logaddexp(0, -z * (2 * y - 1))).sum() + l2 / 2 * (vw @ vw))
        if loss > last:
            vw, vb, t = w.copy(), b, 1.0
            last = np.inf
            continue
        last = loss
        w2, b2 = vw - step * (x.back(r) + l2 * vw), vb - step * r.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    weight = np.zeros(full)
    weight[used] = w
    return Logistic(weight, float(b))


def folded(x: Rows, y: np.ndarray, folds: int, spark: SparkSession | None = None, **how) -> tuple[np.ndarray, Logistic]:
    """(the logit of each row by a model that has not seen it, the model of all rows). With spark the fits run as tasks of their own over the broadcast rows, whose number the sample bounds."""
    of = np.arange(len(x)) % folds
    rests = [np.flatnonzero(of != k) for k in range(folds)] + [np.arange(len(x))]
    if spark is None or not len(x):
        models = [fit(x.take(rest), y[rest], **how) for rest in rests]
    else:
        shared = spark.sparkContext.broadcast((x, y))

        def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    m = fit(shared.value[0].take(rests[k]), shared.value[1][rests[k]], **how)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([m.weight.tobytes()], pa.binary()), pa.array([m.bias], pa.float64())], ["k", "weight", "bias"])

        made = spark.range(0, len(rests), 1, len(rests)).mapInArrow(fits, "k long, weight binary, bias double").collect()
        models = [Logistic(np.frombuffer(r["weight"], np.float64), r["bias"]) for r in sorted(made, key=lambda r: r["k"])]
        shared.destroy()
    out = np.zeros(len(x))
    for k in range(folds):
        own = np.flatnonzero(of == k)
        if len(own):
            out[own] = models[k].logit(x.take(own))
    return out, models[-1]


def out_of_fold(x: Rows, y: np.ndarray, folds: int, **how) -> np.ndarray:
    """The logit of each row by a model that has not seen it."""
    return folded(x, y, folds, **how)[0]


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of Platt's sigmoid(a * logit + b), by Newton steps with smoothed targets."""
    n1 = float(y.sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * logits + b)
        g = np.array([((p - target) * logits).sum() + 1e-3 * (a - 1), (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * logits**2).sum() + 1e-3, (q * logits).sum()], [(q * logits).sum(), q.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        size = np.abs(d).max()
        a, b = a - d[0] * min(1, 2 / max(size, 1e-12)), b - d[1] * min(1, 2 / max(size, 1e-12))
        if size < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def word_codes(words, bits: int) -> np.ndarray:
    """Hashed columns of words."""
    mask, crc = (1 << bits) - 1, zlib.crc32
    return np.array([crc(w) & mask for w in words], np.int64)
