"""Responses as nested JSON to tables and numeric series.

Bodies are a DataFrame with a column `body`; VARIANT keeps the kinds of cells apart, so text and booleans never count as
numbers. What decides the columns of the table - column lists and tag keys - is taken from the series, before rows are
exploded, so that series without rows count too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.epoch import UNIT_NS, text_to_ns
from ..operators.series import series_name


class WireError(RuntimeError):
    pass


def raw_results(bodies: DataFrame) -> DataFrame:
    """result, statement and the series as they came (VARIANT) of each body's results: for schema answers, which need no table."""
    parsed = bodies.select(F.parse_json("body").alias("v"))
    return bodies.sparkSession.sql("SELECT r.pos AS result, coalesce(try_variant_get(r.value, '$.statement_id', 'int'), 0) AS statement, variant_get(r.value, '$.series') AS series FROM {b} JOIN LATERAL variant_explode(variant_get(v, '$.results')) r", b=parsed)


@dataclass
class Response:
    table: DataFrame  # cells as text, in the order of `statement`, series and row
    columns: list[str]
    series: DataFrame  # name, tags, time_ns, time, value
    statements: int

    def kind(self) -> str:
        if not self.series.isEmpty():
            return "series"
        return "empty" if self.table.isEmpty() else "table"

    def counters(self) -> dict[str, int]:
        points = self.series.agg(F.count("*").alias("points"), F.count_distinct("__series").alias("series")).first()
        return {"statements": self.statements, "rows": self.table.count(), "points": points["points"], "series": points["series"]}


def normalize(bodies: DataFrame, precision: str = "") -> Response:
    spark = bodies.sparkSession
    parsed = bodies.select(F.monotonically_increasing_id().alias("doc"), F.parse_json("body").alias("v"))
    results = spark.sql(
        "SELECT doc, r.pos AS result, try_variant_get(v, '$.error', 'string') AS top, try_variant_get(r.value, '$.error', 'string') AS error, try_variant_get(r.value, '$.statement_id', 'int') AS statement, "
        "variant_get(r.value, '$.series') AS series FROM {bodies} LEFT JOIN LATERAL variant_explode_outer(variant_get(v, '$.results')) r",
        bodies=parsed,
    )
    failed = results.where("top IS NOT NULL OR error IS NOT NULL").orderBy("doc", "result").select(F.coalesce("top", "error").alias("e")).first()
    if failed is not None:
        raise WireError(failed["e"])
    series = spark.sql(
        "SELECT doc, result, coalesce(statement, 0) AS statement, s.pos AS pos, try_variant_get(s.value, '$.name', 'string') AS name, coalesce(try_variant_get(s.value, '$.tags', 'map<string,string>'), map()) AS tags, "
        "coalesce(try_variant_get(s.value, '$.columns', 'array<string>'), array()) AS columns, try_variant_get(s.value, '$.values', 'array<variant>') AS cells FROM {results} JOIN LATERAL variant_explode(series) s",
        results=results,
    )
    statements = results.select("doc", "result").where("result IS NOT NULL").distinct().count()
    lists = [r["columns"] for r in series.groupBy("columns").agg(F.min(F.struct("doc", "result", "pos")).alias("at")).orderBy("at").select("columns").collect()]
    tag_keys = sorted(r["k"] for r in series.select(F.explode(F.map_keys("tags")).alias("k")).distinct().collect())
    data = list(dict.fromkeys(c for x in lists for c in x))
    named = bool(tag_keys) or series.limit(2).count() > 1
    rows = series.select("*", F.posexplode("cells").alias("row", "cell")).withColumn("cell", F.expr("try_variant_get(cell, '$', 'array<variant>')"))
    lead = ([("statement", F.col("statement").cast("string"))] if statements > 1 else []) + ([("measurement", F.col("name"))] if named else [])
    lead += [(k, F.col("tags")[k]) for k in tag_keys]
    cells = {c: _cell(c) for c in data}
    names = list(dict.fromkeys([*(n for n, _ in lead), *data]))
    table = rows.select(*(F.coalesce(cells[n], dict(lead)[n]) if n in cells and n in dict(lead) else (cells[n] if n in cells else dict(lead)[n]) for n in names), "doc", "result", "pos", "row") if names else rows.select("doc", "result", "pos", "row")
    table = table.toDF(*(f"{n}" for n in names), "__doc", "__result", "__pos", "__row").orderBy("__doc", "__result", "__pos", "__row").drop("__doc", "__result", "__pos", "__row")
    return Response(table, names, _series(rows, precision), statements)


def _cell(column: str):
    """The last cell under a column of this name, as text; cells beyond a short row are null."""
    at = F.expr(f"size(columns) - array_position(reverse(columns), {_sql(column)})")
    return F.when(F.array_contains("columns", column), F.get("cell", at).cast("string")).alias(column)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _series(rows: DataFrame, precision: str) -> DataFrame:
    """A point for each number beside a time that parses."""
    at = F.array_position(F.transform("columns", F.lower), "time")
    timed = rows.withColumn("__at", at).where("__at > 0").withColumn("__time", F.get("cell", (F.col("__at") - 1).cast("int")))
    long = timed.select("*", F.posexplode("columns").alias("__k", "__column")).where(F.col("__k") != F.col("__at") - 1).withColumn("__v", F.get("cell", F.col("__k")))
    numeric = F.expr("schema_of_variant(__v)").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    text = F.expr("schema_of_variant(__time)") == "STRING"
    own = F.expr("try_variant_get(__time, '$', 'string')")
    fraction = F.coalesce(F.rpad(F.substring(F.regexp_extract(own, r"\.(\d+)", 1), 1, 9), 9, "0").try_cast("long"), F.lit(0).cast("long"))
    seconds = F.unix_seconds(F.try_to_timestamp(F.regexp_replace(own, r"\.\d+", "")))
    ns = F.when(text, seconds * 10**9 + fraction).otherwise(text_to_ns(own, precision if precision in UNIT_NS or precision in ("us", "n") else "ns"))
    value = F.expr("try_variant_get(__v, '$', 'double')")
    out = long.where(numeric).withColumn("time_ns", ns).withColumn("value", value).where(F.col("time_ns").isNotNull() & F.col("value").isNotNull() & (F.abs("value") < float("inf")))
    return out.select(
        series_name(F.col("name"), F.col("__column")).alias("name"),
        F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
        F.timestamp_micros(F.floor(F.col("time_ns") / F.lit(1000).cast("decimal(20,0)")).cast("long")).alias("time"),
        "time_ns",
        "value",
        F.concat_ws("/", "doc", "result", "pos", "__k").alias("__series"),
    )
