"""Language identification by compression.

For each language a zstandard dictionary of raw content is made from texts of that language. Texts and dictionaries are
reduced to lower-case letters (and bytes beyond ASCII) with single spaces between them. A text is cut into chunks of
CHUNK_BYTES, every chunk (so every byte) is compressed once with each dictionary, and the language with the smallest
total wins. Where that is too coarse - texts of up to SHORT_BYTES, whose sizes mostly tie, and totals that differ by less
than MIN_MARGIN - the text is compressed again with PARTS further dictionaries a language, each from other texts of the
sample, at FINE_LEVEL, behind a fixed carrier that doesn't compress (else small texts would be stored as they are), and
those totals decide. Narrow wins are rejected: `accepted` is false where the second best of the totals that decide
exceeds the best by less than MIN_MARGIN of it; the prediction itself is still given.

Fitted on at most TEXTS_PER_LANGUAGE texts a language, each of at most max_bytes, with an even share of DICT_BYTES (or
PART_BYTES) from two places of every text; every document is scored, whole.

Nulls and odd input: a null text, or one without a letter, is "und" with score 0, as is every text if no language could
be learned. Null languages and ids are never learned from. Equal totals: the language that sorts first. Rows are neither
merged nor lost; other columns stay, save those with the names of the result, which are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FIT_TEXT_BYTES, bounded_sample, held_out, small_batches

TEXTS_PER_LANGUAGE = 256
DICT_BYTES = 32 * 1024
CHUNK_BYTES = 2048
LEVEL = 6
SHORT_BYTES = 64
PARTS, PART_BYTES, FINE_LEVEL = 16, 16 * 1024, 19
#: Bytes of the carrier, which are the same in every run.
CARRIER = np.random.default_rng(7).integers(0, 256, 64).astype(np.uint8).tobytes()
#: Share of the best size by which the second best must exceed it.
MIN_MARGIN = 0.01
#: Nats for each byte that a language's total exceeds the best by, for texts of up to a chunk.
BYTE_WEIGHT = 0.5


_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def letters(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


def _slices(text: bytes, size: int, places: int = 2) -> bytes:
    """At most size bytes of a text: all of it, or equal slices from the middles of its parts."""
    if len(text) <= size:
        return text
    part = max(1, size // places)
    middles = [len(text) * (2 * i + 1) // (2 * places) for i in range(places)]
    return b"".join(text[m - part // 2 : m - part // 2 + part] for m in middles)[:size]


class Contents(dict):
    """Raw dictionary content by language, and further contents from parts of the sample."""

    def __init__(self, whole: dict[str, bytes], parts: dict[str, list[bytes]]):
        super().__init__(whole)
        self.parts = parts

    def __reduce__(self):
        return Contents, (dict(self), self.parts)


def learn(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, dict_bytes: int = DICT_BYTES, max_bytes: int = FIT_TEXT_BYTES) -> Contents:
    """Raw dictionary content by language, from documents with a language that aren't held out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    out: dict[str, list[bytes]] = {}
    for r in bounded_sample(known.select("doc_id", "lang"), known, ["lang"], per_language, max_bytes=max_bytes):
        if r["text"]:
            out.setdefault(r["lang"], []).append(letters(r["text"]))
    made, parts = {}, {}
    for lang, texts in sorted(out.items()):
        made[lang] = b"".join(_slices(t, dict_bytes // len(texts)) for t in texts)
        dealt = [texts[k::PARTS] for k in range(min(PARTS, len(texts)))]
        parts[lang] = [b"".join(_slices(t, PART_BYTES // len(own)) for t in own) for own in dealt]
    return Contents(made, parts)


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


class Scorer:
    def __init__(self, contents: dict[str, bytes]):
        self.languages = sorted(contents)
        self.compressors = [_compressor(contents[lang], LEVEL) for lang in self.languages]
        parts = contents.parts if isinstance(contents, Contents) else {lang: [c] for lang, c in contents.items()}
        # Every language has as many, so that totals compare.
        most = max((len(p) for p in parts.values()), default=0)
        self.parts = [[parts[lang][k % len(parts[lang])] for k in range(most)] for lang in self.languages]

    @functools.cached_property
    def fine(self) -> list[list[zstandard.ZstdCompressor]]:
        return [[_compressor(c, FINE_LEVEL) for c in own] for own in self.parts]

    def sizes(self, data: bytes) -> np.ndarray:
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        return np.array([sum(len(c.compress(x)) for x in chunks) for c in self.compressors], np.int64)

    def fine_sizes(self, data: bytes) -> np.ndarray:
        """Totals over the dictionaries of the parts, less what the carrier takes."""
        chunks = [CARRIER + data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        return np.array([sum(len(c.compress(x)) - len(CARRIER) for c in own for x in chunks) for own in self.fine], np.int64)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score from 0 to 1, margin)."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        data = letters(text)
        s, weight = self.sizes(data), BYTE_WEIGHT
        if len(s) > 1 and (len(data) <= SHORT_BYTES or np.partition(s, 1)[1] - s.min() < MIN_MARGIN * s.min()):
            s, weight = self.fine_sizes(data), BYTE_WEIGHT / max(1, len(self.parts[0]))
        best = int(s.argmin())
        over = s - s[best]
        score = 1 / np.exp(-weight * np.minimum(over, 1000 / BYTE_WEIGHT)).sum()
        margin = 1.0 if len(s) == 1 else float(np.partition(over, 1)[1] / max(1, s[best]))
        return self.languages[best], float(score), margin


def identify(docs: DataFrame, contents: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, score, margin and accepted."""
    names = ("lang_pred", "score", "margin", "accepted")
    keep = [c for c in docs.columns if c.lower() not in names]
    if "text" not in keep:
        raise ValueError("a column text is needed")

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(contents)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in it:
            found = [scorer.predict(x.as_py()) for x in b.column(b.schema.get_field_index("text"))]
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())]
            cols.append(pa.array([f[0] != "und" and f[2] >= min_margin for f in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], [*keep, *names])

    source = docs.select(*(f"`{c}`" for c in keep))
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return source.mapInArrow(batches, schema)
