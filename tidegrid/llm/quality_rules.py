"""Quality rules: base counts, and a calibrated logistic regression over hashed word and character n-grams.

Features are shares: of the words, of the pairs of neighbouring words, and of the windows of GRAM characters (code
points) of the text that hash to a column. The models - one for each fold and the final one - are fitted in tasks of
their own over at most SAMPLE labelled rows a class, with texts of at most max_bytes, calibrated by Platt's method on out-of-fold logits, and
scores every whole text in Arrow batches against a fixed threshold.

Nulls and odd input: a null text has no words, counts of zero, and fails the base rules (fewer than MIN_WORDS words),
as empty texts do. Rows with a null label or id are not learned from; without labelled rows of both classes the model
says what the one class says, or nothing is kept. Rows are neither merged nor lost. Columns of the input with the names
of the result are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import FIT_TEXT_BYTES, bounded_sample, small_batches
from .linear import Logistic, Rows, calibrate, folded, sigmoid, word_codes

WORD_BITS, GRAM_BITS = 17, 16
GRAM = 4
SAMPLE = 1200
FOLDS = 4
MIN_ROWS = 5
#: Shares are multiplied by this; it sets how strongly the penalty holds weights down.
SCALE = 20.0
L2 = 1e-4
THRESHOLD = 0.5
# Odd constants of multiplicative hashing.
MIX = (2654435761, 2246822519, 3266489917, 668265263)
# The symbols counted, the white space between words, and the base limits.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Characters of a text that are turned into n-grams at once.
STEP = 1 << 20

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept"]


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more. Hashes find the candidates, words decide."""
    if len(words) < 4:
        return 0
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), np.int64, len(words))
        c = h[:-2] * np.int64(-7046029254386353131) + h[1:-1] * np.int64(-4417276706812531889) + h[2:] * np.int64(1609587929392839161)
    s = np.sort(c)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, c), len(twice) - 1)] == c)
    windows = [(words[i], words[i + 1], words[i + 2]) for i in at.tolist()]
    count = Counter(windows)
    covered = np.zeros(len(words), bool)
    for i, w in zip(at.tolist(), windows):
        if count[w] > 1:
            covered[i : i + 3] = True
    return int(covered.sum())


def base_counts(text: str, data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


def _grams(text: str) -> Iterator[np.ndarray]:
    """Hashed columns of the windows of GRAM characters, step by step."""
    for at in range(0, max(0, len(text) - GRAM + 1), STEP):
        c = np.frombuffer(text[at : at + STEP + GRAM - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(c) - GRAM + 1
        code = c[:n] * np.uint32(MIX[0])
        for k in range(1, GRAM):
            code = (code ^ c[k : n + k]) * np.uint32(MIX[k % len(MIX)])
        yield code >> np.uint32(32 - GRAM_BITS)


def _words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed columns of the words, and of the pairs of neighbours."""
    c = word_codes(words, 32)
    pairs = (c[:-1] * MIX[0] + c[1:] * MIX[1] & 0xFFFFFFFF) >> 32 - WORD_BITS
    return c & (1 << WORD_BITS) - 1, pairs


#: Columns: words, pairs of words, windows of characters.
PARTS = np.cumsum([0, 1 << WORD_BITS, 1 << WORD_BITS, 1 << GRAM_BITS])


def features(text: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    grams = np.zeros(1 << GRAM_BITS, np.int64)
    for g in _grams(text):
        grams += np.bincount(g, minlength=1 << GRAM_BITS)
    j = np.flatnonzero(grams)
    kinds = [np.unique(c, return_counts=True) for c in _words(words)] + [(j, grams[j])]
    return np.concatenate([i + first for (i, _), first in zip(kinds, PARTS)]), np.concatenate([SCALE * n / max(1, n.sum()) for _, n in kinds])


@dataclass
class Model:
    logistic: Logistic
    a: float
    b: float

    def logit(self, text: str, words: list[bytes]) -> float:
        """Equal to the model over features(), without building them."""
        w, z = self.logistic.weight, self.logistic.bias
        for c, first in zip(_words(words), PARTS):
            if len(c):
                z += SCALE * float(w[c + first].mean())
        total, n = 0.0, 0
        own = w[PARTS[2] :]
        for g in _grams(text):
            total += float(own[g].sum())
            n += len(g)
        return z + SCALE * total / max(1, n)

    def probability(self, text: str, words: list[bytes]) -> float:
        return float(sigmoid(np.array(self.a * self.logit(text, words) + self.b)))


def fit_model(texts: list[str], y: np.ndarray, spark: SparkSession | None = None) -> Model:
    x = Rows.of([features(t, t.encode().split()) for t in texts], int(PARTS[-1])).frequent(MIN_ROWS)
    unseen, model = folded(x, y, FOLDS, spark, l2=L2)
    a, b = calibrate(unseen, y)
    return Model(model, a, b)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_bytes: int = FIT_TEXT_BYTES) -> Model:
    """labels: doc_id and quality (0 or 1)."""
    rows = bounded_sample(labels.select("doc_id", "quality"), docs, ["quality"], sample, max_bytes=max_bytes)
    return fit_model([r["text"] or "" for r in rows], np.array([r["quality"] for r in rows], float), docs.sparkSession)


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base counts, base_failed, quality_score (0 to 1) and kept."""
    lower = set(NAMES)
    keep = [c for c in docs.columns if c.lower() not in lower]
    source = docs.select(*(f"`{c}`" for c in keep))
    at = keep.index("text")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for x in batch.column(at):
                text = x.as_py() or ""
                data = text.encode()
                words = data.split()
                counts = base_counts(text, data, words)
                failed = fails(counts[0], counts[4])
                p = shared.value.probability(text, words)
                rows.append((*counts, failed, p, not failed and p >= threshold))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*keep, *NAMES])

    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    return source.mapInArrow(batches, T.StructType([*source.schema.fields, *(T.StructField(n, t) for n, t in zip(NAMES, kinds))]))
