"""Operators over series in long form: (name, tags, time, value), one row a point.

A series is a (name, tags) pair; every operator takes the columns that identify it, and the columns that order its
points. Nothing here gathers a series in one row; windows are partitioned by series.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices that a series is cut into where its points are numbered.
SLICES = 256


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def union_tables(parts: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Series tables (measurement, rows, tags) as one: measurement, sorted union of the tags, other columns in the order they are first seen; what a part lacks is null, and a data column hides a tag of its name."""
    tags = sorted({t for _, _, ts in parts for t in ts})
    data = list(dict.fromkeys(c for _, df, ts in parts for c in df.columns if c not in ts))
    named = any(ts for _, _, ts in parts) or len(parts) > 1
    frames = [df.select(*([F.lit(name).alias("measurement")] if named else []), *df.columns) for name, df, _ in parts]
    out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*(["measurement"] if named else []), *(t for t in tags if t not in data), *data)


def numeric_fields(df: DataFrame, fields: list[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [f for f in fields if kinds[f] not in ("string", "boolean") and not kinds[f].startswith(("timestamp", "date", "array", "map", "struct"))]


def points(df: DataFrame, measurement: str | None, tags: list[str], fields: list[str], time: str = "time") -> DataFrame:
    """Numeric fields as points: name, the tags as columns of their own (tag_0, tag_1, ... in the order given), time, value; nulls and values that aren't finite are left out.

    Group by name and tag columns first, and make maps or labels of the tags on the groups (tag_map).
    """
    numeric = numeric_fields(df, fields)
    own = [f"tag_{k}" for k in range(len(tags))]
    base = df.where(F.col(time).isNotNull()).select(*(F.col(t).cast("string").alias(n) for t, n in zip(tags, own)), F.col(time).alias("time"), *(F.col(f).cast("double").alias(f"field_{k}") for k, f in enumerate(numeric)))
    if not numeric:
        return base.select(F.lit("").alias("name"), *own, "time", F.lit(0.0).alias("value")).where("false")
    pairs = F.array(*(F.struct(series_name(F.lit(measurement), F.lit(f)).alias("name"), F.col(f"field_{k}").alias("value")) for k, f in enumerate(numeric)))
    return base.select(*own, "time", F.inline(pairs)).where(finite(F.col("value"))).select("name", *own, "time", "value")


def tag_map(tags: list[str]) -> Column:
    """The tag columns of points() as a map, null if there are none."""
    if not tags:
        return F.lit(None).cast("map<string,string>")
    return F.map_from_arrays(F.array(*(F.lit(t) for t in tags)), F.array(*(F.col(f"tag_{k}") for k in range(len(tags)))))


def unpivot(df: DataFrame, measurement: str | None, tags: list[str], fields: list[str], time: str = "time") -> DataFrame:
    """Numeric fields as series: name, tags (null if there are none), time, value; nulls and values that aren't finite are left out."""
    return points(df, measurement, tags, fields, time).select("name", tag_map(tags).alias("tags"), "time", "value")


def grouped_points(df: DataFrame, measurement: str | None, tags: list[str], fields: list[str], time: str | None, source_time: str = "time") -> DataFrame:
    """Points by series (and by `time`, if named): name, tag columns, and the least, greatest, sum and number of the values.

    Fields are aggregated side by side in one pass over the rows, and only the groups are turned into long form.
    """
    numeric = numeric_fields(df, fields)
    own = [f"tag_{k}" for k in range(len(tags))]
    value = lambda f: F.when(finite(F.col(f).cast("double")), F.col(f).cast("double"))
    keys = [*(F.col(t).cast("string").alias(n) for t, n in zip(tags, own)), *([F.col(source_time).alias(time)] if time else [])]
    sums = [g(value(f)).alias(f"{n}_{k}") for k, f in enumerate(numeric) for n, g in (("low", F.min), ("high", F.max), ("sum", F.sum), ("n", F.count))]
    wide = df.where(F.col(source_time).isNotNull()).groupBy(*keys).agg(*sums)
    rows = F.array(*(F.struct(series_name(F.lit(measurement), F.lit(f)).alias("name"), *(F.col(f"{n}_{k}").alias(n) for n in ("low", "high", "sum", "n"))) for k, f in enumerate(numeric)))
    return wide.select(*own, *([time] if time else []), F.inline(rows)).where("n > 0")


def series_name(measurement: Column, column: Column) -> Column:
    return F.when(F.coalesce(measurement, F.lit("")) == "", column).when(column.isin("value", "mean"), measurement).otherwise(F.concat(measurement, F.lit("."), column))


def stats(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """min, max, avg and number of the finite values of each series."""
    return df.where(finite(F.col(value))).groupBy(*by).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("avg_value"), F.count(value).alias("points"))


def time_range(df: DataFrame, time: str = "time") -> DataFrame:
    return df.where(F.col(time).isNotNull()).agg(F.min(time).alias("time_from"), F.max(time).alias("time_to"))


def downsample(df: DataFrame, by: list[str], order: list[str], width: int, value: str = "value") -> DataFrame:
    """Means of `width` buckets of neighbouring points: bucket j has the points from floor(j n / w) on; a series of at most `width` points stays as it is."""
    ranked = ranks(df.where(finite(F.col(value))).select(*by, *order, value), by, order)
    bucket = F.when(F.col("__n") <= width, F.col("__i")).otherwise(F.floor(((F.col("__i") + 1) * width - 1) / F.col("__n"))).cast("long")
    return ranked.withColumn("bucket", bucket).groupBy(*by, "bucket").agg(F.avg(value).alias("value"), F.count("*").alias("points"))


def ranks(df: DataFrame, by: list[str], order: list[str], slices: int = SLICES) -> DataFrame:
    """df with __i (place in the series, from 0) and __n (points of the series).

    A series is cut into slices of equal width of its first order column, if that is a number or a time; rows are
    numbered within slices, and the sizes of the slices before are added, so that no task holds a whole series. Points
    with the same value of the first order column share a slice.
    """
    kind = dict(df.dtypes)[order[0]]
    if kind.startswith("timestamp"):
        at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    elif kind in ("bigint", "int", "smallint", "tinyint", "double", "float", "date"):
        at = F.unix_date(order[0]) if kind == "date" else F.col(order[0])
    else:
        s = Window.partitionBy(*by)
        return df.withColumn("__i", F.row_number().over(s.orderBy(*order)).cast("long") - 1).withColumn("__n", F.count("*").over(s))
    same = lambda a, b: functools.reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"__by_{c}"]) for c in by], F.lit(True))
    named = [F.col(c).alias(f"__by_{c}") for c in by]
    ends = df.groupBy(*by).agg(F.min(at).cast("double").alias("__low"), F.max(at).cast("double").alias("__high")).select(*named, "__low", "__high")
    part = F.coalesce(F.least(F.lit(slices - 1), F.floor((at.cast("double") - F.col("__low")) / (F.col("__high") - F.col("__low") + F.lit(1e-9)) * slices)), F.lit(-1)).cast("int")
    cut = df.join(ends, same(df, ends)).withColumn("__slice", part).drop(*ends.columns)
    own = Window.partitionBy(*by, "__slice")
    rows = cut.withColumn("__i", F.row_number().over(own.orderBy(*order)))
    sizes = cut.groupBy(*by, "__slice").agg(F.count("*").alias("__size"))
    series = Window.partitionBy(*by)
    before = F.sum("__size").over(series.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*named, F.col("__slice").alias("__own_slice"), F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__size").over(series).alias("__n"))
    out = rows.join(starts, same(rows, starts) & (F.col("__slice") == F.col("__own_slice")))
    return out.select(*df.columns, (F.col("__before") + F.col("__i") - 1).alias("__i"), "__n")


def levels(reduced: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Level 0 to 7 of each reduced value between the least and greatest reduced value; 4 if they are equal."""
    s = Window.partitionBy(*by)
    low, high = F.min(value).over(s), F.max(value).over(s)
    level = F.when(high == low, 4).otherwise(F.least(F.lit(7), F.greatest(F.lit(0), F.round((F.col(value) - low) / (high - low) * 7))))
    return reduced.withColumn("level", level.cast("int"))


def chart_rows(reduced: DataFrame, raw: DataFrame, by: list[str], value: str = "value", height: int = 8) -> DataFrame:
    """Row from the top of each reduced value on a scale of the raw values; the middle if those are equal."""
    edge = raw.where(finite(F.col(value))).groupBy(*by).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    top = height - 1
    ratio = (F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low"))
    row = F.when(F.col("__high") == F.col("__low"), height // 2).otherwise(F.least(F.lit(top), F.greatest(F.lit(0), top - F.round(ratio * top))))
    return reduced.join(edge, by).withColumn("row", row.cast("int")).drop("__low", "__high")


def chart_connect(rows: DataFrame, by: list[str], order: str = "bucket") -> DataFrame:
    """With the row of the point before, and the rows strictly between, which are drawn in the column before."""
    w = Window.partitionBy(*by).orderBy(order)
    out = rows.withColumn("prev_row", F.lag("row").over(w))
    return out.withColumn("gap", F.greatest(F.lit(0), F.abs(F.col("row") - F.col("prev_row")) - 1))


def out_of_order(df: DataFrame, by: list[str], arrival: str, time: str = "time") -> DataFrame:
    """Points that arrive with a time before that of the point before them."""
    w = Window.partitionBy(*by).orderBy(arrival)
    return df.withColumn("previous_time", F.lag(time).over(w)).where(F.col(time) < F.col("previous_time"))


def last_write_wins(df: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """One row for each key: the one that arrived last."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("__r"))
    return best.select(*key, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*df.columns)


def first_series(df: DataFrame, by: list[str], most: int, order: list[str]) -> DataFrame:
    """Points of the first series, in the order in which they are met, at most `most`."""
    met = df.groupBy(*by).agg(F.min(F.struct(*order)).alias("__met")).orderBy("__met").limit(most).select(*(F.col(c).alias(f"__{c}") for c in by))
    return df.join(met, functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]), "left_semi")
