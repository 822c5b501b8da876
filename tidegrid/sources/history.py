"""Query history: JSON lines on the driver's disk, searched with Spark."""

from __future__ import annotations

import contextlib
import datetime as dt
import fcntl
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "time string, database string, retention_policy string, dialect string, query string"
MAX_ENTRIES, COMPACT_EVERY, SHOWN = 1000, 100, 20
MAX_LINE = 1 << 20


@dataclass
class Store:
    path: Path
    max_entries: int = MAX_ENTRIES
    appended: int = 0

    @contextlib.contextmanager
    def _locked(self) -> Iterator[None]:
        self.path.parent.mkdir(mode=0o700, parents=True, exist_ok=True)
        with open(f"{self.path}.lock", "a") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def append(self, query: str, database: str = "", retention_policy: str = "", dialect: str = "influxql", time: dt.datetime | None = None) -> None:
        """Blank queries are passed over; now and then, or when the file has grown large, only the last entries are kept."""
        query = query.strip()
        if not query:
            return
        entry = {"time": (time or dt.datetime.now(dt.UTC)).isoformat(), "database": database, "retention_policy": retention_policy, "dialect": dialect, "query": query}
        with self._locked():
            with open(os.open(self.path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600), "a") as f:
                f.write(json.dumps(entry, ensure_ascii=False) + "\n")
            self.appended += 1
            every = 1 if self.max_entries <= SHOWN else COMPACT_EVERY
            if self.appended % every == 0 or self.path.stat().st_size > self.max_entries * 4096:
                self._compact()

    def entries(self) -> list[dict]:
        """What can be read, with ids from 1 in the order of the file."""
        if not self.path.exists():
            return []
        out = []
        for line in self.path.read_text(encoding="utf-8", errors="replace").splitlines():
            if not line.strip() or len(line.encode()) > MAX_LINE:
                continue
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if isinstance(e, dict) and str(e.get("query") or "").strip():
                out.append(e | {"id": len(out) + 1})
        return out

    def _compact(self) -> None:
        kept = self.entries()[-self.max_entries :]
        temporary = Path(f"{self.path}.new")
        with open(os.open(temporary, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            f.writelines(json.dumps({k: v for k, v in e.items() if k != "id"}, ensure_ascii=False) + "\n" for e in kept)
        os.replace(temporary, self.path)

    def search(self, text: str = "", limit: int = SHOWN) -> list[dict]:
        """The latest entries first, of those that have the text in any field, whatever its case."""
        low = text.lower()
        found = [e for e in reversed(self.entries()) if any(low in str(e.get(k) or "").lower() for k in ("query", "database", "retention_policy", "dialect"))]
        return found[: max(1, min(limit, MAX_ENTRIES))]


def load(spark: SparkSession, path: str) -> DataFrame:
    """A history file as a table with ids, for files too large for one reader: entries are numbered within the parts of the file, after the sizes of the parts before."""
    raw = spark.read.schema(SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("__at", F.monotonically_increasing_id())
    kept = raw.where("_bad IS NULL AND trim(query) <> ''")
    kept = kept.withColumn("__part", F.shiftright("__at", 33))
    sizes = kept.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("__part").alias("__p"), before.alias("__before"))  # a row for each part of the file
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__at"))
    rows = kept.withColumn("__own", own).join(starts, F.col("__part") == F.col("__p"))
    return rows.select((F.col("__before") + F.col("__own")).cast("long").alias("id"), *(c.split()[0] for c in SCHEMA.split(", ")))


def matching(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows that have the text in one of the columns, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return df.where(hit)


def matching_joined(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """As matching, over the columns joined with spaces: a match may run on from one to the next."""
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


def latest(df: DataFrame, order: list[str], limit: int = SHOWN) -> DataFrame:
    return df.orderBy(*(F.desc(c) for c in order)).limit(max(1, min(limit, MAX_ENTRIES)))
