"""Synthetic datasets as closed forms of the row number: spark.range and column expressions, in batch and stream."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.epoch import precision
from ..functions.text import host_name, pid_name, region_name
from ..sources.lineproto import line

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
MEASUREMENTS = {"demo-cpu": "demo_cpu", "high-cardinality": "high_cardinality", "out-of-order": "out_of_order_cpu", "covering-block": "covering_block_cpu", "stress-basic": "cpu"}
MAX_BATCH = 100_000
DAY = 86400 * 10**9


@dataclass(frozen=True)
class Options:
    dataset: str
    start_ns: int | None = None
    rate: int = 100
    duration_ns: int = 60 * 10**9
    hosts: int = 10
    pids: int = 1000
    points: int = 100
    series: int = 100_000
    tick_ns: int = 10 * 10**9
    ratio: float = 0.0
    batch_size: int = 5000
    precision: str = "ns"
    measurement: str | None = None


@dataclass(frozen=True)
class Plan:
    """What a run will make; every figure follows from the options."""

    options: Options
    total: int
    interval_ns: int
    start_ns: int
    end_ns: int

    @property
    def batches(self) -> int:
        return -(-self.total // self.options.batch_size)

    @property
    def measurement(self) -> str:
        return self.options.measurement or MEASUREMENTS[self.options.dataset]

    @property
    def data_range_ns(self) -> tuple[int, int]:
        o = self.options
        return (self.start_ns + o.tick_ns, self.start_ns + o.tick_ns * o.points) if o.dataset == "stress-basic" else (self.start_ns, self.end_ns)

    def summary(self) -> dict[str, object]:
        first, last = self.data_range_ns
        return {"dataset": self.options.dataset, "measurement": self.measurement, "points": self.total, "batches": self.batches, "batch_size": self.options.batch_size, "interval_ns": self.interval_ns, "data_from_ns": first, "data_to_ns": last}


def plan(o: Options, now_ns: int | None = None) -> Plan:
    if o.dataset not in MEASUREMENTS:
        raise ValueError(f"unknown dataset {o.dataset!r}; one of {', '.join(MEASUREMENTS)}")
    for name in ("rate", "duration_ns", "hosts", "pids", "points", "series", "tick_ns", "batch_size"):
        if getattr(o, name) <= 0:
            raise ValueError(f"{name} must be positive")
    if o.batch_size > MAX_BATCH:
        raise ValueError(f"batch size must be at most {MAX_BATCH}")
    if not 0 <= o.ratio <= 1:
        raise ValueError("ratio must be between 0 and 1")
    o = replace(o, precision=precision(o.precision))
    if o.dataset == "stress-basic":
        total, span = o.points * o.series, o.tick_ns * o.points
        interval = o.tick_ns
    else:
        total = max(1, math.ceil(o.rate * o.duration_ns / 10**9))
        span, interval = o.duration_ns, max(1, o.duration_ns // total)
    if total >= 2**63 or span >= 2**63:
        raise ValueError("too many points")
    now = now_ns if now_ns is not None else (dt.datetime.now(dt.UTC) - EPOCH) // dt.timedelta(microseconds=1) * 1000
    start = o.start_ns if o.start_ns is not None else now - span
    return Plan(o, total, interval, start, start + span)


def columns(p: Plan, i: Column) -> list[Column]:
    """seq, tags, fields and time_ns of row i."""
    o = p.options
    div = lambda a, b: F.floor(a / F.lit(b)).cast("long")
    at = lambda k: F.lit(p.start_ns) + k * p.interval_ns
    h = i % o.hosts
    seq = i.alias("seq")
    if o.dataset == "demo-cpu":
        user, system = 15 + 45 * F.abs(F.sin(i / 17)), 5 + 12 * F.abs(F.cos(i / 29))
        return [seq, host_name(h).alias("host"), region_name(h).alias("region"), F.lit("cpu-total").alias("cpu"), user.alias("usage_user"), system.alias("usage_system"), F.greatest(F.lit(0.0), 100 - user - system).alias("usage_idle"), at(i).alias("time_ns")]
    if o.dataset == "high-cardinality":
        pid = div(i, o.hosts) % o.pids
        return [seq, host_name(h).alias("host"), pid_name(pid).alias("pid"), F.format_string("svc-%02d", pid % 64).alias("service"), region_name(h).alias("region"), (i * 37 % 1000 / 10).alias("value"), at(i).alias("time_ns")]
    if o.dataset == "out-of-order":
        every = max(1, round(1 / o.ratio)) if o.ratio else 0
        off = max(2 * every, o.rate)
        k = F.when((i >= off) & (i % every == 0), i - off).otherwise(i) if o.ratio else i
        return [seq, host_name(h).alias("host"), region_name(h).alias("region"), (50 + 30 * F.sin(i / 11)).alias("usage_idle"), at(k).alias("time_ns")]
    if o.dataset == "covering-block":
        base = max(1, p.total * 7 // 10)
        window = max(1, base // 5)
        k = F.when(i < base, i).otherwise((i - base) % window)
        return [seq, host_name(k % o.hosts).alias("host"), region_name(k % o.hosts).alias("region"), (35 + i * 19 % 500 / 10).alias("usage_idle"), at(k).alias("time_ns")]
    s, step = i % o.series, div(i, o.series)
    return [seq, F.concat(F.lit("server-"), s.cast("string")).alias("host"), F.lit("us-west").alias("location"), (i * 37 % 1000).cast("double").alias("value"), (F.lit(p.start_ns) + (step + 1) * o.tick_ns).alias("time_ns")]


#: Tags of each dataset, in the order of its lines.
TAGS = {"demo-cpu": ["host", "region", "cpu"], "high-cardinality": ["host", "pid", "service", "region"], "out-of-order": ["host", "region"], "covering-block": ["host", "region"], "stress-basic": ["host", "location"]}


def generate(spark: SparkSession, p: Plan, partitions: int | None = None) -> DataFrame:
    """All rows; the rows are cut into ranges, no row depends on another."""
    ids = spark.range(0, p.total, 1, partitions) if partitions else spark.range(p.total)
    return ids.select(*columns(p, F.col("id"))).withColumn("batch", F.floor(F.col("seq") / F.lit(p.options.batch_size)).cast("long"))


def lines(df: DataFrame, p: Plan) -> DataFrame:
    """seq, batch and line of generated rows."""
    tags = TAGS[p.options.dataset]
    fields = [c for c in df.columns if c not in (*tags, "seq", "batch", "time_ns")]
    return df.select("seq", "batch", line(p.measurement, tags, fields, df, p.options.precision).alias("line"))


def stream(spark: SparkSession, p: Plan, rows_per_batch: int = 5000) -> DataFrame:
    """The same rows as an endless micro-batch stream of row numbers; rates are simulated, not slept."""
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", 4).load()
    return source.where(F.col("value") < p.total).select(*columns(p, F.col("value")))
