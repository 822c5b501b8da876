"""Shared helpers: tables, shared scratch storage, bounded labelled samples, Arrow batches."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import new_path

#: Words are the maximal runs of characters other than these (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"

#: Default bound on the bytes of a text that a model is fitted on (longer ones are still scored whole).
FIT_TEXT_BYTES = 65_536
#: Cells that hashes of labelled rows are dealt into for each row wanted, rows kept in each, and rows drawn for each wanted.
CELL_ROWS, SPARE = 16, 4
#: Rows of an Arrow batch.
ARROW_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that may be broadcast: a sample of labelled ids is checked against it.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage is cut and the rows outlive any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that no later step reads."""
    for df in tables:
        path = df.__dict__.pop("_settled_path", None)
        if path is not None:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def scratch_file():
    """A nameless file on the worker's own disk, in Spark's local folder, for one task's use."""
    return tempfile.TemporaryFile(dir=(os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None)


def small_batches(spark: SparkSession) -> None:
    """Let this session's Arrow batches have ARROW_ROWS rows at most: both sides hold whole batches, and documents may be long."""
    if int(spark.conf.get(_BATCH)) > ARROW_ROWS:
        spark.conf.set(_BATCH, str(ARROW_ROWS))


def trim() -> None:
    """Give freed memory back, as Python workers live on and are used again by other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back by hand
        return


def squeeze(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(kind).reshape(-1)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] of them, for all i."""
    total = int(count.sum())
    base = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(count) else np.zeros(0, np.int64)
    return base + np.arange(total)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name in taken:
        n += 1
        name = f"__{stem}_{n}"
    return name


def replacing(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with columns added; columns of those names (in any case) that df had are left out."""
    lower = {k.lower() for k in new}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in lower), *(v.alias(k) for k, v in new.items()))


def hashable(df: DataFrame) -> list[str]:
    """Columns that have a hash."""
    return [f"`{f.name}`" for f in df.schema.fields if "map" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2 (null ids are held out too)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def _least(df: DataFrame, by: list, order: list, most: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def bounded_sample(labelled: DataFrame, docs: DataFrame, classes: list[str], per_class: int, seed: int = 17, max_bytes: int = FIT_TEXT_BYTES) -> list[dict]:
    """At most per_class rows for each combination of `classes`, with their texts of at most max_bytes, on the driver.

    labelled: doc_id and the class columns. Rows are drawn by the smallest hashes of doc_id, so the sample is bounded and
    the same for any partitioning: hashes are dealt into cells, cells keep CELL_ROWS rows each, of these SPARE * per_class
    rows are looked up among the documents, and the first per_class that have a usable text are taken. Rows with a null
    id or class aren't used; of documents with one id the smallest text counts.
    """
    known = labelled.select("doc_id", *classes).where(F.col("doc_id").isNotNull()).dropna(subset=classes).distinct()
    known = known.withColumn("__h", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("__cell", F.pmod("__h", F.lit(per_class)))
    cells = _least(known, [*classes, "__cell"], ["__h", "doc_id"], CELL_ROWS)
    drawn = settle(_least(cells, classes, ["__h", "doc_id"], SPARE * per_class).drop("__cell"), "drawn")
    usable = docs.where(F.octet_length("text") <= max_bytes).select("doc_id", "text")
    few = drawn.count() <= BROADCAST_ROWS
    found = usable.join(F.broadcast(drawn) if few else drawn, "doc_id").groupBy("doc_id", *classes, "__h").agg(F.min("text").alias("text"))
    rows = _least(found, classes, ["__h", "doc_id"], per_class).drop("__h").orderBy("doc_id", *classes).toArrow().to_pylist()
    discard(drawn)
    seen, kept = set(), []
    for r in rows:
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            kept.append(r)
    return kept


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    for x in column.cast(kind):
        yield x.as_py() or b""


def word_runs(data: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of data (see WORD) in lists that cover about `step` bytes each, however long the text is."""
    n, start = len(data), 0
    while start < n:
        stop = min(n, start + step)
        if stop < n:
            m = _SPACE.search(data, stop)
            stop = m.start() if m else n
        yield data[start:stop].split()
        start = stop


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying text by text; null is empty."""
    col = column.cast(pa.large_binary())
    buf = col.buffers()
    offs = np.frombuffer(buf[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buf[2], dtype=np.uint8) if buf[2] is not None else np.zeros(0, np.uint8)
    if col.null_count:
        texts = [x or b"" for x in col.to_pylist()]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
        return data, offs
    return data[offs[0] : offs[-1]] if len(offs) else data, offs - offs[0]
