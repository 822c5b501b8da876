"""Statements to lazy DataFrames: Catalyst does the planning.

Decisions where the language leaves room: without a time bucket an aggregate has no time column; buckets start at the
epoch (plus the offset); empty buckets appear only with FILL, between the bounds of the WHERE clause or, where it has
none, of the result; LIMIT and OFFSET count within each series when grouped by tags; SLIMIT and SOFFSET count tag sets
in order; one clock reading serves a whole statement. Division by zero and its remainder are null. `*` inside a function
stands for every field it can take (numbers, or all for count). Functions of neighbouring points (difference, derivative,
moving_average, ...) work on the points of a tag set in the order of time, or on the buckets of an aggregate, and rows
where they all are null are left out; top, bottom and distinct stand alone. A pattern behind FROM joins all measurements
that match it, with their names. median and percentile interpolate and are exact: the distinct values of a group meet in
one task; median_approx and percentile_approx keep a sketch of ACCURACY instead, whose ranks are off by 1 / ACCURACY at
most. INTO registers the result as a measurement of the catalog.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import functools
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, Measurement, series_cardinality, series_keys, tag_values
from .lexer import QueryError, dialect, statements
from .parser import Binary, Call, Create, Drop, Duration, Explain, Literal, Name, Regex, Select, Show, Source, Star, parse

EPOCH = dt.datetime(1970, 1, 1)

AGGREGATES: dict[str, Callable[..., Column]] = {
    "mean": lambda c, t: F.avg(c),
    "count": lambda c, t: F.count(c),
    "sum": lambda c, t: F.sum(c),
    "min": lambda c, t: F.min(c),
    "max": lambda c, t: F.max(c),
    "first": lambda c, t: F.min_by(c, F.when(c.isNotNull(), t)),
    "last": lambda c, t: F.max_by(c, F.when(c.isNotNull(), t)),
    "spread": lambda c, t: F.max(c) - F.min(c),
    "median": lambda c, t: F.median(c),
    "stddev": lambda c, t: F.stddev_samp(c),
    "mode": lambda c, t: F.mode(c, True),
    "percentile": lambda c, t, n: F.percentile(c, F.lit(n / 100)),
    "median_approx": lambda c, t: F.approx_percentile(c.cast("double"), F.lit(0.5), F.lit(ACCURACY)),
    "percentile_approx": lambda c, t, n: F.approx_percentile(c.cast("double"), F.lit(n / 100), F.lit(ACCURACY)),
}
#: Functions of neighbouring points: value, time in nanoseconds, window, argument.
_PREVIOUS = lambda c, w: F.lag(c).over(w)
NEIGHBOURS: dict[str, Callable[..., Column]] = {
    "difference": lambda c, t, w, n: c - _PREVIOUS(c, w),
    "non_negative_difference": lambda c, t, w, n: F.when(c >= _PREVIOUS(c, w), c - _PREVIOUS(c, w)),
    "derivative": lambda c, t, w, n: F.try_divide((c - _PREVIOUS(c, w)).cast("double") * n, t - _PREVIOUS(t, w)),
    "non_negative_derivative": lambda c, t, w, n: F.when(c >= _PREVIOUS(c, w), F.try_divide((c - _PREVIOUS(c, w)).cast("double") * n, t - _PREVIOUS(t, w))),
    "elapsed": lambda c, t, w, n: F.floor((t - _PREVIOUS(t, w)) / F.lit(n)).cast("long"),
    "cumulative_sum": lambda c, t, w, n: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    "moving_average": lambda c, t, w, n: F.when(F.count(c).over(w.rowsBetween(1 - n, 0)) == n, F.avg(c).over(w.rowsBetween(1 - n, 0))),
}
#: Functions whose second argument is a duration, and its default in nanoseconds.
UNITS = {"derivative": 10**9, "non_negative_derivative": 10**9, "elapsed": 1}
ACCURACY = 10_000
SCALARS: dict[str, Callable[..., Column]] = {k: getattr(F, k) for k in ("abs", "sin", "cos", "tan", "sqrt", "exp", "ln", "floor", "ceil", "round", "log2", "log10", "pow")}
_OPS = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": F.try_divide, "%": F.try_mod, "=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "!=": "!=", "<>": "<>"}


def _time_literal(us: int, like: str) -> Column:
    t = EPOCH + dt.timedelta(microseconds=us)
    return F.expr(f"{'timestamp_ntz' if like == 'timestamp_ntz' else 'timestamp'}'{t.isoformat(sep=' ')}{'' if like == 'timestamp_ntz' else 'Z'}'")


def _parse_time(text: str) -> int:
    t = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    t = t.astimezone(dt.UTC).replace(tzinfo=None) if t.tzinfo else t
    return (t - EPOCH) // dt.timedelta(microseconds=1)


class Compiler:
    def __init__(self, spark: SparkSession, catalog: Catalog, database: str | None = None, policy: str | None = None, now: Callable[[], dt.datetime] | None = None):
        self.spark, self.catalog, self.database, self.policy, self.tags = spark, catalog, database, policy, []
        self.now_us = ((now or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None)))() - EPOCH) // dt.timedelta(microseconds=1)

    # Statements.

    def run(self, text: str) -> DataFrame:
        if dialect(text) == "flux":
            raise QueryError("unsupported dialect: flux")
        parts = [self.statement(parse(s)) for s in statements(text)]
        if not parts:
            raise QueryError("empty statement")
        if len(parts) == 1:
            return parts[0]
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.select(F.lit(i).alias("statement"), *p.columns) for i, p in enumerate(parts)))

    def statement(self, s) -> DataFrame:
        if isinstance(s, Select):
            return self.into(s) if s.into else self.select(s)[0]
        if isinstance(s, Explain):
            plan = self.select(s.query)[0]._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self.spark.createDataFrame([(line,) for line in plan.splitlines()], "plan string")
        if isinstance(s, Create):
            self.catalog.create_database(s.database)
            return self.spark.createDataFrame([], "name string")
        if isinstance(s, Drop):
            self.catalog.drop_database(s.name) if s.what == "database" else self.catalog.drop_measurement(self.database, s.name)
            return self.spark.createDataFrame([], "name string")
        return self.show(s)

    def into(self, q: Select) -> DataFrame:
        """The result becomes a measurement; the answer is the number of rows."""
        df, tags = self.select(q, inner=True)
        names = q.into.names
        database, policy = (names[0], names[1]) if len(names) == 3 else (self.database, names[0] if len(names) == 2 else self.policy)
        rows = df if "time" in df.columns else df.withColumn("time", F.lit(EPOCH))
        kinds = dict(rows.dtypes)
        tags = [*tags, *(c for c in rows.columns if kinds[c] == "string" and c not in tags and c in self.tags)]
        self.catalog.register(database, policy or self.catalog.default_policy(database), names[-1], rows, "time", tags, [c for c in rows.columns if c != "time" and c not in tags])
        return rows.agg(F.count("*").alias("written"))

    def show(self, s: Show) -> DataFrame:
        db, name = s.database or self.database, s.source.names[-1] if s.source and s.source.names else None
        if s.what == "databases":
            return self.catalog.show_databases()
        if s.what == "retention policies":
            return self.catalog.show_retention_policies(db).drop("database").withColumnRenamed("retention_policy", "name")
        if s.what == "measurements":
            return self.catalog.show_measurements(db, self.policy)
        if s.what == "field keys":
            return self.catalog.field_keys(db, self.policy, name)
        if s.what == "tag keys":
            return self.catalog.tag_keys(db, self.policy, name)
        named = [self.measurement(s.source)] if s.source and s.source.names else self.catalog.measurements(db, self.policy, s.source.pattern if s.source else None)
        if s.what == "series cardinality":
            return series_cardinality(named[0]) if s.source and s.source.names else functools.reduce(DataFrame.union, (series_cardinality(m).select(F.lit(m.name).alias("measurement"), "cardinality") for m in named))
        if s.what == "series":
            return functools.reduce(DataFrame.union, map(series_keys, named)).orderBy("key")
        if s.source and s.source.names and len(s.keys) == 1:
            return tag_values(named[0], s.keys[0]).orderBy("value")
        found = [tag_values(m, k).select(F.lit(m.name).alias("measurement"), "key", "value") for m in named for k in s.keys if k in m.tags]
        if not found:
            return self.spark.createDataFrame([], "measurement string, key string, value string")
        return functools.reduce(DataFrame.union, found).orderBy("measurement", "key", "value")

    def measurement(self, source: Source) -> Measurement:
        names = source.names
        if len(names) == 3:
            return self.catalog.lookup(names[0], names[1] or None, names[2])
        if len(names) == 2:
            return self.catalog.lookup(self.database, names[0], names[1])
        return self.catalog.lookup(self.database, self.policy, names[0])

    def relation(self, source: Source) -> Measurement:
        if source.pattern is not None:
            found = self.catalog.measurements(self.database, self.policy, source.pattern)
            if not found:
                raise QueryError(f"no measurement matches /{source.pattern}/")
            tags, fields = sorted({t for m in found for t in m.tags}), {f: k for m in found for f, k in m.fields.items()}
            fields = {f: k for f, k in fields.items() if f not in tags}
            df = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (m.df.select(F.lit(m.name).alias("measurement"), "time", *(F.col(f"`{c}`").cast("double") if m.fields.get(c) in ("float", "integer") else F.col(f"`{c}`") for c in m.columns() if c != "time")) for m in found))
            return Measurement("", df, ["measurement", *tags], fields)
        if source.query is None:
            return self.measurement(source)
        df, tags = self.select(source.query, inner=True)
        return Measurement("", df, tags, {c: "float" for c in df.columns if c not in tags and c != "time"})

    # Queries.

    def select(self, q: Select, inner: bool = False) -> tuple[DataFrame, list[str]]:
        """(result, tags that group it)."""
        if q.source is None:
            row = self.spark.range(1)
            return row.select(*(self.constant(e).alias(a or _label(e)) for e, a in q.fields)), []
        m = self.relation(q.source)
        self.tags = m.tags
        q = self.expanded(q, m)
        self.kind = dict(m.df.dtypes).get("time", "timestamp")
        df = m.df if q.where is None else m.df.where(self.condition(q.where, m, self.kind))
        tags = sorted(m.tags) if q.all_tags else q.tags
        for t in tags:
            if t not in m.tags:
                raise QueryError(f"unknown tag {t!r}")
        if q.source.pattern is not None and "measurement" not in tags and any(_aggregates(e) or _moves(e) for e, _ in q.fields):
            tags = ["measurement", *tags]
        if any(isinstance(e, Call) and e.name in ("top", "bottom", "distinct") for e, _ in q.fields):
            return self.finish(self.chosen(df, m, q, tags), q, tags, inner), tags
        if any(_moves(e) for e, _ in q.fields):
            return self.finish(self.moved(df, m, q, tags), q, tags, inner), tags
        calls = [(e, a) for e, a in q.fields if _aggregates(e)]
        if calls and len(calls) < len(q.fields):
            raise QueryError("aggregates and plain fields can't be mixed")
        if calls:
            out, cols = self.aggregate(df, m, q, tags)
        else:
            cols = self.plain_columns(q, m)
            keep = [t for t in tags if t not in dict(cols)]
            time = [F.col("time")] if "time" in df.columns else []
            out = df.select(*time, *keep, *(c.alias(n) for n, c in cols))
        return self.finish(out, q, tags, inner), tags

    def expanded(self, q: Select, m: Measurement) -> Select:
        """q with * inside a function written out for every field that the function takes."""
        fields = []
        for e, alias in q.fields:
            inner = e.args[0] if isinstance(e, Call) and e.args and isinstance(e.args[0], Call) else e
            if isinstance(inner, Call) and inner.args and isinstance(inner.args[0], Star):
                taken = sorted(f for f, k in m.fields.items() if inner.name == "count" or k in ("float", "integer"))
                for f in taken:
                    own = Call(inner.name, (Name(f), *inner.args[1:]))
                    fields.append((own if inner is e else Call(e.name, (own, *e.args[1:])), f"{alias or e.name}_{f}"))
            else:
                fields.append((e, alias))
        return dataclasses.replace(q, fields=fields)

    def chosen(self, df: DataFrame, m: Measurement, q: Select, tags: list[str]) -> DataFrame:
        """top, bottom or distinct of each tag set (and bucket)."""
        if len(q.fields) > 1:
            raise QueryError("top, bottom and distinct stand alone")
        e, alias = q.fields[0]
        if not e.args or len(e.args) != (1 if e.name == "distinct" else 2):
            raise QueryError(f"wrong arguments of {e.name}()")
        value, name = self.value(e.args[0], m), alias or e.name
        keys = [F.col(f"`{t}`") for t in tags]
        bucket = [self.bucket(q).alias("time")] if q.every_ns else []
        if e.name == "distinct":
            return df.select(*bucket, *keys, value.alias(name)).where(F.col(name).isNotNull()).distinct()
        if not (isinstance(e.args[1], Literal) and isinstance(e.args[1].value, int) and e.args[1].value > 0):
            raise QueryError(f"{e.name}() needs a number of points")
        rows = df.select("time", *keys, value.alias(name), *([self.bucket(q).alias("__bucket")] if q.every_ns else [])).where(F.col(f"`{name}`").isNotNull())
        by = [*tags, *(["__bucket"] if q.every_ns else [])]
        order = F.col(f"`{name}`").desc() if e.name == "top" else F.col(f"`{name}`").asc()
        n = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(order, "time"))
        return rows.withColumn("__n", n).where(F.col("__n") <= e.args[1].value).select("time", *keys, f"`{name}`")

    def moved(self, df: DataFrame, m: Measurement, q: Select, tags: list[str]) -> DataFrame:
        """Functions of neighbouring points of each tag set, or of the buckets of aggregates."""
        calls = []
        for e, alias in q.fields:
            if not _moves(e) or not e.args:
                raise QueryError("functions of neighbouring points can't be mixed with others")
            extra = e.args[1] if len(e.args) > 1 else None
            if e.name == "moving_average":
                if not (isinstance(extra, Literal) and isinstance(extra.value, int) and extra.value > 1):
                    raise QueryError("moving_average() needs a number of points")
                n = extra.value
            elif e.name in UNITS:
                if extra is not None and not isinstance(extra, Duration):
                    raise QueryError(f"{e.name}() needs a duration")
                n = extra.ns if extra is not None else UNITS[e.name]
            else:
                n = 0
            calls.append((e, alias or e.name, n))
        inner = [e.args[0] for e, _, _ in calls]
        nested = [_aggregates(e) for e in inner]
        if any(nested):
            if not all(nested) or not q.every_ns:
                raise QueryError("functions of neighbouring buckets need aggregates and a time bucket")
            base, _ = self.aggregate(df, m, dataclasses.replace(q, fields=[(e, f"__v{k}") for k, e in enumerate(inner)]), tags)
        else:
            base = df.select("time", *(F.col(f"`{t}`") for t in tags), *(self.value(e, m).alias(f"__v{k}") for k, e in enumerate(inner)))
            base = base.where(functools.reduce(operator.or_, [F.col(f"__v{k}").isNotNull() for k in range(len(inner))]))
        w = Window.partitionBy(*(tags or [F.lit(0)])).orderBy("time")
        t = F.unix_micros(F.col("time").cast("timestamp")) * 1000
        cols = _unique([(name, NEIGHBOURS[e.name](F.col(f"__v{k}"), t, w, n)) for k, (e, name, n) in enumerate(calls)])
        out = base.select("time", *(F.col(f"`{c}`") for c in tags), *(c.alias(n) for n, c in cols))
        return out.where(functools.reduce(operator.or_, [F.col(f"`{n}`").isNotNull() for n, _ in cols]))

    def plain_columns(self, q: Select, m: Measurement) -> list[tuple[str, Column]]:
        out: list[tuple[str, Column]] = []
        for e, alias in q.fields:
            if isinstance(e, Star):
                out += [(c, F.col(f"`{c}`")) for c in m.columns() if c != "time"]
            elif not (isinstance(e, Name) and e.value.lower() == "time"):
                out.append((alias or _label(e), self.value(e, m)))
        return _unique(out)

    def bucket(self, q: Select) -> Column:
        width, shift = q.every_ns // 1000, (q.offset_ns // 1000) % max(1, q.every_ns // 1000)
        if width < 1:
            raise QueryError("time buckets under a microsecond")
        return F.window("time", f"{width} microseconds", f"{width} microseconds", f"{shift} microseconds")["start"]

    def aggregate(self, df: DataFrame, m: Measurement, q: Select, tags: list[str]) -> tuple[DataFrame, list[tuple[str, Column]]]:
        nested = [e for e, _ in q.fields if isinstance(e, Call) and e.name in AGGREGATES and e.args and isinstance(e.args[0], Call) and e.args[0].name in AGGREGATES]
        keys = [F.col(f"`{t}`") for t in tags]
        time = [self.bucket(q).alias("time")] if q.every_ns else []
        if nested:
            if len(nested) != len(q.fields):
                raise QueryError("nested and plain aggregates can't be mixed")
            if not q.every_ns:
                raise QueryError("nested aggregates need a time bucket")
            inner = _unique([(_label(e.args[0]), self.call(e.args[0], m)) for e, _ in q.fields])
            steps = df.groupBy(*time, *keys).agg(*(c.alias(f"__{n}") for n, c in inner))
            outer = _unique([(a or e.name, AGGREGATES[e.name](F.col(f"__{n}"), F.col("time"))) for (e, a), (n, _) in zip(q.fields, inner)])
            return steps.groupBy(*keys).agg(*(c.alias(n) for n, c in outer)), outer
        cols = _unique([(a or _label(e), self.value(e, m)) for e, a in q.fields])
        out = df.groupBy(*time, *keys).agg(*(c.alias(n) for n, c in cols))
        if q.every_ns and q.fill is not None and q.fill != "none":
            out = self.filled(out, q, tags, [n for n, _ in cols])
        return out, cols

    def filled(self, out: DataFrame, q: Select, tags: list[str], names: list[str]) -> DataFrame:
        """Every bucket between the bounds for every tag set of the result."""
        low, high = self.bounds(q.where)
        us = q.every_ns // 1000
        floor = lambda t: t - (t - (q.offset_ns // 1000)) % us
        edges = out.agg(F.min("time").alias("__low"), F.max("time").alias("__high"))
        if low is not None:
            edges = edges.withColumn("__low", _time_literal(floor(low), self.kind))
        if high is not None:
            edges = edges.withColumn("__high", _time_literal(floor(high - 1), self.kind))
        step = F.expr(f"make_dt_interval(0, 0, 0, {us / 1e6:.6f})")
        grid = edges.where("__low <= __high").select(F.explode(F.sequence("__low", "__high", step)).alias("time"))
        if tags:
            grid = out.select(*(f"`{t}`" for t in tags)).distinct().join(grid)
        g = grid.select(F.col("time").alias("__t"), *(F.col(f"`{t}`").alias(f"__{t}") for t in tags))
        on = functools.reduce(operator.and_, [F.col("__t") == out["time"], *(F.col(f"__{t}").eqNullSafe(out[t]) for t in tags)])
        full = g.join(out, on, "left").select(F.col("__t").alias("time"), *(F.col(f"__{t}").alias(t) for t in tags), *names)
        if q.fill == "null":
            return full
        if isinstance(q.fill, (int, float)):
            return full.select("time", *tags, *(F.coalesce(F.col(n), F.lit(q.fill).cast(full.schema[n].dataType)).alias(n) for n in names))
        series = Window.partitionBy(*tags) if tags else Window.partitionBy(F.lit(0))
        before = series.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
        if q.fill == "previous":
            return full.select("time", *tags, *(F.last(n, ignorenulls=True).over(before).alias(n) for n in names))
        after = series.orderBy("time").rowsBetween(0, Window.unboundedFollowing)
        t = F.unix_micros(F.col("time").cast("timestamp")).cast("double")
        made = []
        for n in names:
            at = F.when(F.col(n).isNotNull(), t)
            v0, t0 = F.last(n, ignorenulls=True).over(before), F.last(at, ignorenulls=True).over(before)
            v1, t1 = F.first(n, ignorenulls=True).over(after), F.first(at, ignorenulls=True).over(after)
            made.append(F.when(F.col(n).isNotNull(), F.col(n).cast("double")).when(v0.isNotNull() & v1.isNotNull(), v0 + (v1 - v0) * (t - t0) / (t1 - t0)).alias(n))
        return full.select("time", *tags, *made)

    def finish(self, out: DataFrame, q: Select, tags: list[str], inner: bool) -> DataFrame:
        if q.slimit is not None or q.soffset:
            if not tags:
                raise QueryError("SLIMIT and SOFFSET need GROUP BY tags")
            sets = out.select(*tags).distinct().orderBy(*tags)
            sets = sets.offset(q.soffset) if q.soffset else sets
            sets = sets if q.slimit is None else sets.limit(q.slimit)
            s = sets.select(*(F.col(t).alias(f"__{t}") for t in tags))
            out = out.join(s, functools.reduce(operator.and_, [out[t].eqNullSafe(F.col(f"__{t}")) for t in tags]), "left_semi")
        timed = "time" in out.columns
        rest = [c for c in out.columns if c != "time" and c not in tags]
        order = [F.desc("time") if q.descending else F.asc("time")] if timed else []
        if (q.limit is not None or q.offset) and tags:
            n = F.row_number().over(Window.partitionBy(*tags).orderBy(*order, *rest))
            ranked = out.withColumn("__n", n).where(F.col("__n") > q.offset)
            out = (ranked if q.limit is None else ranked.where(F.col("__n") <= q.offset + q.limit)).drop("__n")
        elif q.limit is not None or q.offset:
            out = out.orderBy(*order, *rest)
            out = out.offset(q.offset) if q.offset else out
            out = out if q.limit is None else out.limit(q.limit)
        elif not inner and (order or tags):
            out = out.orderBy(*tags, *order)
        if q.tz and timed:
            out = out.withColumn("time", F.from_utc_timestamp(F.col("time").cast("timestamp"), q.tz))
        return out

    # Expressions.

    def value(self, e, m: Measurement) -> Column:
        if isinstance(e, Name):
            if e.value not in m.tags and e.value not in m.fields and e.value.lower() != "time":
                raise QueryError(f"unknown field {e.value!r}")
            return F.col(f"`{e.value}`")
        if isinstance(e, Literal):
            return F.lit(e.value)
        if isinstance(e, Call):
            return self.call(e, m)
        if isinstance(e, Binary) and e.op in "+-*/%":
            return _OPS[e.op](self.value(e.left, m), self.value(e.right, m))
        raise QueryError(f"unsupported expression {_label(e)}")

    def call(self, e: Call, m: Measurement) -> Column:
        if e.name in AGGREGATES:
            if not e.args:
                raise QueryError(f"{e.name}() needs a field")
            if e.name == "count" and isinstance(e.args[0], Call) and e.args[0].name == "distinct" and len(e.args[0].args) == 1:
                return F.count_distinct(self.value(e.args[0].args[0], m))
            extra = [a.value for a in e.args[1:] if isinstance(a, Literal)]
            if (e.name in ("percentile", "percentile_approx")) != bool(extra):
                raise QueryError(f"wrong arguments of {e.name}()")
            return AGGREGATES[e.name](self.value(e.args[0], m), F.col("time") if "time" in m.df.columns else F.lit(0), *extra)
        if e.name in NEIGHBOURS or e.name in ("top", "bottom", "distinct"):
            raise QueryError(f"{e.name}() can't be part of an expression")
        if e.name in SCALARS:
            return SCALARS[e.name](*(self.value(a, m) for a in e.args))
        raise QueryError(f"unknown function {e.name}()")

    def constant(self, e) -> Column:
        us = self.time_value(e)
        return _time_literal(us, "timestamp") if isinstance(us, int) and not isinstance(e, Literal) else self.value(e, Measurement("", self.spark.range(0), [], {}))

    def time_value(self, e) -> int | None:
        """Microseconds since the epoch that an expression of now(), durations, numbers (ns) and time texts means; None if it isn't one."""
        if isinstance(e, Call) and e.name == "now" and not e.args:
            return self.now_us
        if isinstance(e, Duration):
            return e.ns // 1000
        if isinstance(e, Literal) and isinstance(e.value, int) and not isinstance(e.value, bool):
            return e.value // 1000
        if isinstance(e, Literal) and isinstance(e.value, str):
            try:
                return _parse_time(e.value)
            except ValueError:
                return None
        if isinstance(e, Binary) and e.op in "+-":
            a, b = self.time_value(e.left), self.time_value(e.right)
            return None if a is None or b is None else a + b if e.op == "+" else a - b
        return None

    def _time_test(self, e) -> tuple[str, int] | None:
        """(operator, microseconds) of a comparison of time with a constant."""
        if not isinstance(e, Binary) or e.op not in _FLIP:
            return None
        for side, other, op in ((e.left, e.right, e.op), (e.right, e.left, _FLIP[e.op])):
            if isinstance(side, Name) and side.value.lower() == "time":
                us = self.time_value(other)
                if us is None:
                    raise QueryError("time is compared with what isn't one")
                return op, us
        return None

    def bounds(self, e) -> tuple[int | None, int | None]:
        """[low, high) in microseconds that a conjunction of comparisons gives."""
        if isinstance(e, Binary) and e.op == "and":
            (a, b), (c, d) = self.bounds(e.left), self.bounds(e.right)
            return max((x for x in (a, c) if x is not None), default=None), min((x for x in (b, d) if x is not None), default=None)
        op, us = self._time_test(e) or ("", 0)
        return {">=": (us, None), ">": (us + 1, None), "<": (None, us), "<=": (None, us + 1), "=": (us, us + 1)}.get(op, (None, None))

    def condition(self, e, m: Measurement, kind: str) -> Column:
        if isinstance(e, Binary) and e.op in ("and", "or"):
            return (operator.and_ if e.op == "and" else operator.or_)(self.condition(e.left, m, kind), self.condition(e.right, m, kind))
        if test := self._time_test(e):
            return _OPS[test[0]](F.col("time"), _time_literal(test[1], kind))
        if isinstance(e, Binary) and e.op in ("=~", "!~"):
            if not isinstance(e.right, Regex):
                raise QueryError("a regular expression is needed")
            hit = self.value(e.left, m).cast("string").rlike(e.right.value)
            return hit if e.op == "=~" else ~hit
        if isinstance(e, Binary) and e.op in _FLIP:
            return _OPS[e.op](self.value(e.left, m), self.value(e.right, m))
        if isinstance(e, Literal) and isinstance(e.value, bool):
            return F.lit(e.value)
        raise QueryError(f"not a condition: {_label(e)}")


def _aggregates(e) -> bool:
    if isinstance(e, Call):
        return e.name in AGGREGATES or any(map(_aggregates, e.args))
    return isinstance(e, Binary) and (_aggregates(e.left) or _aggregates(e.right))


def _moves(e) -> bool:
    return isinstance(e, Call) and e.name in NEIGHBOURS


def _label(e) -> str:
    if isinstance(e, Call):
        return e.name
    if isinstance(e, Name):
        return e.value
    if isinstance(e, Binary):
        return f"{_label(e.left)}_{_label(e.right)}"
    return re.sub(r"\W+", "_", str(getattr(e, "value", "value")))


def _unique(cols: list[tuple[str, Column]]) -> list[tuple[str, Column]]:
    """Repeated names get _1, _2, ..."""
    seen: dict[str, int] = {}
    out = []
    for n, c in cols:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append((f"{n}_{k}" if k else n, c))
    return out
