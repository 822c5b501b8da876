"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms: pairs of neighbouring character classes (letters one by one, other kinds together) and a few
terms of its shape (share of distinct words, of words equal to the one before, of repeated lines, of capitals, and its
length, each in steps). Counts are damped, weighted by inverse document frequency and brought to length one; a truncated
singular value decomposition of the labelled sample, by subspace iteration, gives the latent space. The labelled
vectors - at most SAMPLE a class, so at most 2 * SAMPLE * DIMENSIONS floats - are broadcast. Every document is compared
with all of them, exactly, by blocked matrix products, and its NEIGHBOURS nearest vote with weights that grow with
their similarity.

Nulls and odd input: a null text is empty, has terms of its shape only, and is scored like any other. Rows with a null
label or id aren't learned from; without labelled rows the score is 0. Similarities are rounded to five digits, and ties
broken by place in the sample, which is ordered. Rows are neither merged nor lost. Columns of the input with the names of the result are
replaced.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FIT_TEXT_BYTES, as_bytes, bounded_sample, held_out, small_batches, trim

SAMPLE = 1500
DIMENSIONS = 64
NEIGHBOURS = 25
#: Votes weigh similarity to this power.
SHARPNESS = 16
THRESHOLD = 0.7
#: Similarities are rounded to this part of one.
DIGITS = 100_000
SEED = 11
STEPS = 10
#: Documents of a block.
BLOCK = 512
#: Weight of a term of shape, in units of the length of the character terms.
SHAPE_WEIGHT = 0.5


def _classes() -> np.ndarray:
    """Class of each byte: letters in lower case one by one, ASCII punctuation one by one, then digits, capitals, blanks, line ends, control bytes and bytes beyond ASCII."""
    out = np.zeros(256, np.int64)
    n = 6
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 0
        elif c == "\n":
            out[b] = 1
        elif c in " \t\x0b\x0c\r":
            out[b] = 2
        elif "0" <= c <= "9":
            out[b] = 3
        elif "A" <= c <= "Z":
            out[b] = 4
        elif b < 32 or b == 127:
            out[b] = 5
        else:
            out[b] = n
            n += 1
    return out


_CLASS = _classes()
_KINDS = int(_CLASS.max()) + 1
_SHAPES = 5
TERMS = _KINDS * _KINDS + _SHAPES * (STEPS + 1)


def terms(data: bytes) -> np.ndarray:
    """Counts of character terms, and flags of the terms of shape."""
    out = np.zeros(TERMS, np.float32)
    for at in range(0, len(data), 1 << 20):
        c = _CLASS[np.frombuffer(data[at : at + (1 << 20) + 1], np.uint8)]
        if len(c) > 1:
            out[: _KINDS * _KINDS] += np.bincount(c[:-1] * _KINDS + c[1:], minlength=_KINDS * _KINDS)
    words = data.split()
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    capitals = sum(map(bytes.isupper, words))
    shares = (len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)), capitals / n, min(1.0, np.log2(1 + len(words)) / 15))
    for k, s in enumerate(shares):
        out[_KINDS * _KINDS + k * (STEPS + 1) + int(round(float(s) * STEPS))] = 1
    return out


@dataclass
class Model:
    idf: np.ndarray
    space: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows x dimensions
    votes: np.ndarray  # labels of those rows

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weigh(counts, self.idf) @ self.space)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.votes))
        for at in range(0, len(texts) if k else 0, BLOCK):
            cosine = self.embed(np.stack([terms(t) for t in texts[at : at + BLOCK]])) @ self.vectors.T
            n = cosine.shape[1]
            place = np.rint(-cosine * DIGITS).astype(np.int64) * n + np.arange(n)
            near = np.sort(np.partition(place, k - 1, axis=1)[:, :k] if k < n else place, axis=1)
            rounded, near = -(near // n) / DIGITS, near % n
            w = np.clip(rounded, 1e-6, 1) ** SHARPNESS
            out[at : at + len(cosine)] = (w * self.votes[near]).sum(axis=1) / w.sum(axis=1)
        return np.clip(out, 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    split = _KINDS * _KINDS
    chars = np.log1p(counts[:, :split]) * idf[:split]
    return np.hstack([_unit(chars), counts[:, split:] * SHAPE_WEIGHT]).astype(np.float32)


def fit_model(texts: list[bytes], labels: np.ndarray) -> Model:
    if not texts:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    counts = np.stack([terms(t) for t in texts])
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    a = np.empty_like(counts)
    for at in range(0, len(a), BLOCK):  # on the driver, so in blocks
        a[at : at + BLOCK] = _weigh(counts[at : at + BLOCK], idf)
    del counts
    d = min(DIMENSIONS, len(texts))
    q = np.random.default_rng(SEED).standard_normal((TERMS, d + 8)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    small = a @ q
    _, _, vt = np.linalg.svd(small, full_matrices=False)
    space = (q @ vt.T[:, :d]).astype(np.float32)
    return Model(idf, space, _unit(a @ space), labels.astype(float))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_bytes: int = FIT_TEXT_BYTES) -> Model:
    """labels: doc_id and quality (0 or 1). Held-out rows are not learned from, nor texts over max_bytes."""
    known = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    rows = bounded_sample(known, docs, ["quality"], sample, max_bytes=max_bytes)
    model = fit_model([(r["text"] or "").encode() for r in rows], np.array([r["quality"] for r in rows], float))
    del rows
    trim()
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on, else 0)."""
    names = ["score", "predicted"]
    keep = [c for c in docs.columns if c.lower() not in names]
    source = docs.select(*(f"`{c}`" for c in keep))
    at = keep.index("text")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(0, batch.num_rows, BLOCK):
                b = batch.slice(k, BLOCK)
                s = shared.value.scores(list(as_bytes(b.column(at))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, *names])

    return source.mapInArrow(batches, T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
