"""Toxicity by a classifier chain.

The categories are predicted in order by logistic regressions over hashed words; the model of each category also gets
the probabilities of the categories before it. In fitting these come out of fold - from models that have not seen the
row - so that later models learn from probabilities as honest as those they meet in scoring.

Fitted on at most SAMPLE rows for each combination of category labels, on the driver; every document is scored, whole.

Nulls and odd input: a null or wordless text gets what the intercepts say; rows with a null label or id are not learned
from; with no labelled rows every probability is next to 0. Rows are neither merged nor lost. Columns of the input with
the names of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import FIT_TEXT_BYTES, as_bytes, bounded_sample, small_batches
from .linear import Logistic, Rows, folded, sigmoid, word_codes

BITS = 18
SAMPLE = 3000
FOLDS = 4
#: Rows of the sample that must have a word before it gets a weight.
MIN_ROWS = 3
#: Lengths in bytes of the word beginnings that count as terms of their own.
STEMS = (4, 6, 8)
L2 = 2e-4
#: Chi-square with the category that a term needs (one degree of freedom: one in a thousand by chance).
CHI_SQUARE = 10.83
THRESHOLD = 0.5

_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or 48 <= x <= 57 or x >= 128 else 32 for x in range(256))


def features(data: bytes) -> np.ndarray:
    """Hashed columns of the distinct words (letters and digits only, in lower case) and of their beginnings."""
    words = set(data.translate(_WORDS).split())
    codes = [word_codes(words, BITS)]
    for n in STEMS:
        codes.append(word_codes({w[:n] + b"-" for w in words if len(w) > n}, BITS))
    return np.unique(np.concatenate(codes))


@dataclass
class Chain:
    categories: list[str]
    models: list[Logistic]

    def probabilities(self, x: Rows) -> np.ndarray:
        """(rows, categories)."""
        p = np.zeros((len(x), len(self.models)))
        for k, m in enumerate(self.models):
            width = len(m.weight) - k
            p[:, k] = sigmoid(x.dot(m.weight[:width]) + p[:, :k] @ m.weight[width:] + m.bias)
        return p


def fit_chain(texts: list[bytes], labels: np.ndarray, categories: list[str], spark: SparkSession | None = None) -> Chain:
    x = Rows.of([(f, np.ones(len(f))) for f in map(features, texts)], 1 << BITS).frequent(MIN_ROWS)
    models, before = [], np.zeros((len(texts), 0))
    for k in range(len(categories)):
        own = x.with_dense(before) if k else x
        unseen, model = folded(own, labels[:, k], FOLDS, spark, l2=L2, least=CHI_SQUARE)
        models.append(model)
        before = np.column_stack([before, sigmoid(unseen)])
    return Chain(categories, models)


def learn(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, max_bytes: int = FIT_TEXT_BYTES) -> Chain:
    """labels: doc_id and a 0/1 column for each category. Fitted on at most `sample` rows a combination, with texts of at most max_bytes."""
    rows = bounded_sample(labels.select("doc_id", *categories), docs, categories, sample, max_bytes=max_bytes)
    y = np.array([[r[c] for c in categories] for r in rows], float).reshape(len(rows), len(categories))
    return fit_chain([(r["text"] or "").encode() for r in rows], y, categories, docs.sparkSession)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """docs with <category>_score (0 to 1) and <category> (1 from the threshold on) for each category."""
    names = [n for c in chain.categories for n in (f"{c}_score", c)]
    lower = {n.lower() for n in names}
    keep = [c for c in docs.columns if c.lower() not in lower]
    source = docs.select(*(f"`{c}`" for c in keep))
    at = keep.index("text")
    small_batches(docs.sparkSession)
    shared, categories = docs.sparkSession.sparkContext.broadcast(chain), len(chain.categories)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            p = np.concatenate([np.zeros((0, categories)), *(shared.value.probabilities(Rows.of([(f, np.ones(len(f)))], 1 << BITS)) for f in map(features, as_bytes(b.column(at))))])
            cols = [c for k in range(p.shape[1]) for c in (pa.array(p[:, k]), pa.array((p[:, k] >= threshold).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*keep, *names])

    added = [T.StructField(n, T.DoubleType() if n.endswith("_score") else T.IntegerType()) for n in names]
    return source.mapInArrow(batches, T.StructType([*source.schema.fields, *added]))
