"""The template language for mock data: scripts parsed on the driver, rows as expressions of the row number.

Tag templates are dealt like digits of a mixed-radix number, the first one fastest; a timestamp lasts for all
combinations of them. Random values are a hash of a seed, the template and the draw: as deterministic and as evenly
spread as a generator's, and the same in any partitioning, but not the bits of any particular generator.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.epoch import UNIT_NS, precision
from ..plans.lexer import duration_ns

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
DEFAULT_START = dt.datetime(2016, 1, 1, tzinfo=dt.UTC)
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
SEED = 1
MAX_LINE = 1 << 20


class IqlError(ValueError):
    pass


@dataclass(frozen=True)
class Template:
    """[a|b|c], or [type fn(arg) count]."""

    options: tuple[str, ...] = ()
    kind: str = ""
    fn: str = ""
    arg: int = 0
    count: int = 0

    @property
    def cardinality(self) -> int:
        return len(self.options) or self.count


@dataclass
class Insert:
    head: str
    fields: str
    count: int
    tick_ns: int


@dataclass
class Script:
    statements: list[tuple] = field(default_factory=list)


@dataclass
class Settings:
    database: str = ""
    retention_policy: str = ""
    precision: str = "s"
    start: dt.datetime = DEFAULT_START
    batch_size: int = 5000
    forced: frozenset[str] = frozenset()
    ignored: list[str] = field(default_factory=list)

    def set(self, name: str, value: str) -> None:
        """Known names take effect unless the caller forced them; others are noted once, whatever their case."""
        key = name.lower().replace("_", "")
        key = {"rp": "retentionpolicy"}.get(key, key)
        if key in self.forced:
            return
        if key == "database":
            self.database = value
        elif key == "retentionpolicy":
            self.retention_policy = value
        elif key == "precision":
            self.precision = _precision(value)
        elif key == "startdate":
            self.start = parse_start(value)
        elif key == "batchsize":
            if not value.isdigit() or int(value) < 1:
                raise IqlError(f"invalid batch size {value!r}")
            self.batch_size = int(value)
        elif name.lower() not in (x.lower() for x in self.ignored):
            self.ignored.append(name)


def _precision(name: str) -> str:
    return "s" if name.strip().lower() in ("", "rfc3339", "rfc3339nano") else precision(name)


def parse_start(text: str) -> dt.datetime:
    if text.strip().lower() == "now":
        return dt.datetime.now(dt.UTC)
    t = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=dt.UTC)


def parse_script(text: str) -> Script:
    lines = []
    for raw in text.splitlines():
        if len(raw.encode()) > MAX_LINE:
            raise IqlError("line too long")
        if not raw.strip().startswith("#"):
            lines.append(raw.strip())
    out, i = Script(), 0
    while i < len(lines):
        line = lines[i]
        words, low = line.split(), line.lower()
        i += 1
        if not line:
            continue
        if low.startswith("set "):
            a, b = line.find("["), line.rfind("]")
            name = line[4 : a if a >= 0 else None].split()
            if len(name) != 1 or (a >= 0 and b < a):
                raise IqlError(f"invalid SET {line!r}")
            out.statements.append(("set", name[0], line[a + 1 : b].strip() if a >= 0 else ""))
        elif low.startswith("use ") and len(words) == 2:
            out.statements.append(("set", "Database", words[1]))
        elif low.startswith(("insert ", "go insert ")) or low in ("insert", "go insert"):
            body = []
            while i < len(lines) and not (body and re.fullmatch(r"\d+\s+(?:\d+(?:ns|ms|u|µ|[smhdw]))+", lines[i])):
                if lines[i]:
                    body.append(lines[i])
                i += 1
            if i == len(lines):
                raise IqlError("INSERT without a count and an interval")
            count, tick = lines[i].split()
            i += 1
            if len(body) < 2:
                raise IqlError("INSERT needs a measurement, fields and a count")
            if int(count) < 1 or duration_ns(tick) < 1:
                raise IqlError("count and interval must be positive")
            out.statements.append(("insert", Insert("".join(body[:-1]), body[-1], int(count), duration_ns(tick))))
        elif low.startswith(("query ", "go query ")) or low in ("query", "go query"):
            times = 1
            while i < len(lines) and lines[i]:
                if m := re.fullmatch(r"do\s+(\d+)", lines[i].lower()):
                    times = int(m[1])
                i += 1
            if m := re.search(r"\bdo\s+(\d+)$", low):
                times = int(m[1])
            out.statements.append(("query", times))
        elif low == "wait":
            out.statements.append(("wait",))
        else:
            out.statements.append(("raw", line))
    return out


def parse_template(text: str) -> list[str | Template]:
    """Literal parts and templates, in order."""
    out: list[str | Template] = []
    at = 0
    while (a := text.find("[", at)) >= 0:
        b = text.find("]", a)
        if b < 0:
            raise IqlError("unterminated template")
        out.append(text[at:a])
        body = text[a + 1 : b]
        if m := re.fullmatch(r"\s*(\S+)\s+(\w+)\(\s*(-?\d+)\s*\)\s+(\d+)\s*", body):
            out.append(Template(kind=m[1].lower(), fn=m[2].lower(), arg=int(m[3]), count=int(m[4])))
        elif "|" in body or not re.search(r"\(", body):
            out.append(Template(options=tuple(body.split("|"))))
        else:
            raise IqlError(f"invalid template [{body}]")
        at = b + 1
    out.append(text[at:])
    return out


def _random(a: int, key: int, draw: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), F.lit(key), draw.cast("long")), F.lit(max(1, a)))


def _value(t: Template, key: int, draw: Column, group: Column) -> Column:
    """Text of a template: draw counts its uses, group the timestamps."""
    if t.options:
        return F.element_at(F.array(*map(F.lit, t.options)), (draw % len(t.options) + 1).cast("int"))
    step = draw % t.count if t.count else group if t.fn == "inc" else draw
    if t.kind == "str":
        if t.fn != "rand":
            return F.lit("IQL_STR_ERROR")
        marks = [F.substring(F.lit(LETTERS), (_random(len(LETTERS), key * 1000 + k, step) + 1).cast("int"), 1) for k in range(max(0, t.arg))]
        return F.concat(*marks) if marks else F.lit("")
    if t.kind not in ("int", "float"):
        return F.lit("IQL_TEMPLATE_ERROR")
    if t.fn not in ("inc", "rand"):
        return F.lit(f"IQL_{t.kind.upper()}_ERROR")
    number = F.lit(t.arg) + step if t.fn == "inc" else _random(t.arg, key, step) if t.arg > 0 else F.lit(0)
    return F.concat(number.cast("long").cast("string"), F.lit("i" if t.kind == "int" else ""))


def insert_lines(spark: SparkSession, ins: Insert, start: dt.datetime, unit: str, key: int = 0, partitions: int | None = None) -> DataFrame:
    """seq, line and time_ns of one INSERT."""
    head, body = parse_template(ins.head), parse_template(ins.fields)
    stride, tags = 1, []
    for t in (x for x in head if isinstance(x, Template)):
        if t.cardinality < 1:
            raise IqlError("tag templates need a finite cardinality")
        tags.append(stride)
        stride *= t.cardinality
        if stride >= 2**63:
            raise IqlError("too many series")
    ids = spark.range(0, ins.count, 1, partitions) if partitions else spark.range(ins.count)
    i = F.col("id")
    div = lambda a, n: F.floor(a / F.lit(n)).cast("long")
    group, parts, used = div(i, stride), [], 0
    for x in head:
        if isinstance(x, Template):
            parts.append(_value(x, key + used, div(i, tags[used]) % x.cardinality, group))
            used += 1
        elif x:
            parts.append(F.lit(x))
    parts.append(F.lit(" "))
    for k, x in enumerate(body):
        if isinstance(x, Template):
            parts.append(_value(x, key + 100 + k, i, group))
        elif x:
            parts.append(F.lit(x))
    start_ns = (start - EPOCH) // dt.timedelta(microseconds=1) * 1000
    ns = F.lit(start_ns) + group * ins.tick_ns
    stamp = F.floor(ns / F.lit(UNIT_NS[unit]).cast("decimal(20,0)")).cast("long")
    return ids.select(i.alias("seq"), F.concat(*parts, F.lit(" "), stamp.cast("string")).alias("line"), ns.alias("time_ns"))


@dataclass
class Run:
    lines: DataFrame  # statement, seq, batch, line, time_ns
    settings: Settings
    points: int = 0
    batches: int = 0
    skipped_queries: int = 0
    raw: int = 0

    def measured(self) -> dict[str, int | None]:
        """Points and the first and last time, from the lines themselves."""
        r = self.lines.agg(F.count("*").alias("points"), F.min("time_ns").alias("from_ns"), F.max("time_ns").alias("to_ns")).first()
        return {"points": r["points"], "data_from_ns": r["from_ns"], "data_to_ns": r["to_ns"]}


def run(spark: SparkSession, text: str, settings: Settings | None = None, dry_run: bool = True, partitions: int | None = None) -> Run:
    """The lines of a script, lazily, and the counts that follow from it; batches never span statements."""
    s = settings or Settings()
    frames: list[DataFrame] = []
    out = Run(spark.createDataFrame([], "statement int, seq long, batch long, line string, time_ns long"), s)
    for st in parse_script(text).statements:
        if st[0] == "set":
            s.set(st[1], st[2])
        elif st[0] == "query":
            out.skipped_queries += st[1]
        elif st[0] == "raw":
            out.raw += 1
        elif st[0] == "insert":
            if not s.database and not dry_run:
                raise IqlError("database is required for iql ingest")
            ins, n = st[1], len(frames)
            df = insert_lines(spark, ins, s.start, s.precision, n * 1000, partitions)
            frames.append(df.select(F.lit(n).alias("statement"), "seq", (F.floor(F.col("seq") / F.lit(s.batch_size)) + out.batches).cast("long").alias("batch"), "line", "time_ns"))
            out.points += ins.count
            out.batches += -(-ins.count // s.batch_size)
    if frames:
        out.lines = functools.reduce(DataFrame.unionByName, frames)
    return out
