"""The registered queries over the driver's tables, each with SQL that DuckDB can run on the same tables.

Roles: `events` has time ts, tags event_type and user_id, fields value and k (from its JSON column); `orders` and
`lineitem` likewise. Floating-point results are rounded to six digits on both sides; order-dependent queries break ties
by a primary key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import epoch, text
from ..operators import datasets, iql, series
from ..sources import history, lineproto, wire
from ..sources.catalog import Catalog, RetentionPolicy, first_value, merged_schema, tag_cardinality
from ..streaming import twins
from .compiler import Compiler

NOW = dt.datetime(2024, 1, 31)
EVENT_TAGS, LINE_TAGS, LINE_FIELDS = ["event_type"], ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
START_NS = 1_704_067_200 * 10**9  # 2024-01-01

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    c = Catalog(spark)
    c.create_database("metrics", [RetentionPolicy("autogen", "0s", "168h0m0s", "1", True), RetentionPolicy("short", "24h0m0s", "1h0m0s", "1")])
    c.create_database("telegraf", [RetentionPolicy("raw", "720h0m0s", "24h0m0s", "1", True)])
    c.register_later("metrics", "autogen", "events", lambda: _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")), "ts", ["event_type", "user_id"], ["value", "k", "event_id"])
    c.register_later("metrics", "autogen", "orders", lambda: _table(spark, sf_dir, "orders"), "o_orderdate", ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_orderkey"])
    c.register_later("metrics", "short", "lineitem", lambda: _table(spark, sf_dir, "lineitem"), "l_shipdate", LINE_TAGS, [*LINE_FIELDS, "l_orderkey"])
    return c


def run(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A statement in metrics.autogen, with a fixed clock."""
    return Compiler(spark, catalog(spark, sf_dir), "metrics", "autogen", lambda: NOW).run(statement)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def _ql(name: str, statement: str, sql: str, *rounded: str) -> None:
    _query(name, sql)(lambda spark, sf_dir: _rounded(run(spark, sf_dir, statement), *rounded))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_HOUR, _DAY = "time_bucket(INTERVAL '1 hour', ts)", "time_bucket(INTERVAL '1 day', ts)"

_ql("ql_select_star_limit", "SELECT * FROM events ORDER BY time LIMIT 10", f"SELECT ts AS time, event_id, event_type, {_K} AS k, CAST(user_id AS VARCHAR) AS user_id, round(value, 6) AS value FROM events ORDER BY ts, event_id LIMIT 10", "value")
_ql("ql_mean_by_time", "SELECT mean(value) FROM events GROUP BY time(1h)", f"SELECT {_HOUR} AS time, round(avg(value), 6) AS mean FROM events GROUP BY 1", "mean")
_ql("ql_mean_by_time_tag", "SELECT mean(value) FROM events WHERE time >= '2024-01-02T00:00:00Z' GROUP BY time(1h), event_type", f"SELECT {_HOUR} AS time, event_type, round(avg(value), 6) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-02' GROUP BY 1, 2", "mean")
_ql("ql_offset_bucket", "SELECT sum(value) FROM events GROUP BY time(7h, 30m)", "SELECT time_bucket(INTERVAL '7 hours', ts, TIMESTAMP '1970-01-01 00:30:00') AS time, round(sum(value), 6) AS sum FROM events GROUP BY 1", "sum")
_ql("ql_time_range", "SELECT value FROM events WHERE time > now() - 10d AND time <= now() - 1d - 12h", "SELECT ts AS time, value FROM events WHERE ts > TIMESTAMP '2024-01-21' AND ts <= TIMESTAMP '2024-01-29 12:00:00'")
_ql("ql_tag_and_or", "SELECT count(value) FROM events WHERE (event_type = 'click' OR event_type = 'view') AND user_id != '7' AND value > 1.5 GROUP BY event_type", "SELECT event_type, count(value) AS count FROM events WHERE event_type IN ('click', 'view') AND user_id <> 7 AND value > 1.5 GROUP BY 1")
_ql("ql_tag_regex", "SELECT count(value) FROM events WHERE event_type =~ /^[a-p].*e/ AND user_id !~ /9$/ GROUP BY event_type", "SELECT event_type, count(value) AS count FROM events WHERE regexp_matches(event_type, '^[a-p].*e') AND user_id % 10 <> 9 GROUP BY 1")
_ql("ql_count", "SELECT count(value), count(k) FROM events", f"SELECT count(value) AS count, count({_K}) AS count_1 FROM events")
_ql("ql_nested_max_mean", "SELECT max(mean(value)) FROM events GROUP BY time(1h), event_type", f"SELECT event_type, round(max(m), 6) AS max FROM (SELECT {_HOUR} AS t, event_type, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1", "max")
_ql("ql_subquery", "SELECT max(mean), min(mean) FROM (SELECT mean(value) FROM events GROUP BY time(1d), event_type) GROUP BY event_type", f"SELECT event_type, round(max(m), 6) AS max, round(min(m), 6) AS min FROM (SELECT {_DAY} AS t, event_type, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1", "max", "min")
_ql(
    "ql_aggregates",
    "SELECT sum(value), min(value), max(value), first(value), last(value), spread(value), median(value), stddev(value), percentile(value, 90), count(distinct(k)) AS n_distinct FROM events GROUP BY event_type",
    f"SELECT event_type, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max, arg_min(value, ts) AS first, arg_max(value, ts) AS last, round(max(value) - min(value), 6) AS spread, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS stddev, round(quantile_cont(value, 0.9), 6) AS percentile, count(DISTINCT {_K}) AS n_distinct FROM events GROUP BY 1",
    "sum", "spread", "median", "stddev", "percentile",
)
_ql("ql_arithmetic", "SELECT value * 2 + k AS score, value / 4 AS quarter, k % 7 AS rest FROM events WHERE k >= 50", f"SELECT ts AS time, round(value * 2 + {_K}, 6) AS score, round(value / 4, 6) AS quarter, {_K} % 7 AS rest FROM events WHERE {_K} >= 50", "score", "quarter")
_ql("ql_aggregate_arithmetic", "SELECT max(value) - min(value) AS width, sum(value) / count(value) AS average FROM events GROUP BY time(1d)", f"SELECT {_DAY} AS time, round(max(value) - min(value), 6) AS width, round(sum(value) / count(value), 6) AS average FROM events GROUP BY 1", "width", "average")
_ql("ql_divide_by_zero", "SELECT value / k AS ratio, k % k AS rest, event_id % (k - 10) AS odd FROM events", f"SELECT ts AS time, round(value / nullif({_K}, 0), 6) AS ratio, {_K} % nullif({_K}, 0) AS rest, event_id % nullif({_K} - 10, 0) AS odd FROM events", "ratio")
_ql("ql_star_aggregates", "SELECT count(*), mean(*) FROM events GROUP BY event_type", f"SELECT event_type, count(event_id) AS count_event_id, count({_K}) AS count_k, count(value) AS count_value, round(avg(event_id), 6) AS mean_event_id, round(avg({_K}), 6) AS mean_k, round(avg(value), 6) AS mean_value FROM events GROUP BY 1", "mean_event_id", "mean_k", "mean_value")
_ql("ql_distinct", "SELECT distinct(k) FROM events GROUP BY event_type", f'SELECT DISTINCT event_type, {_K} AS "distinct" FROM events WHERE {_K} IS NOT NULL')
_ql("ql_distinct_by_time", "SELECT distinct(user_id) AS who FROM events GROUP BY time(1d)", f"SELECT DISTINCT {_DAY} AS time, CAST(user_id AS VARCHAR) AS who FROM events WHERE user_id IS NOT NULL")
_DAILY = f"(SELECT {_DAY} AS time, event_type, avg(value) AS m FROM events GROUP BY 1, 2)"
_DAYS_W = "WINDOW w AS (PARTITION BY event_type ORDER BY time)"
_ql("ql_difference", "SELECT difference(mean(value)), non_negative_difference(mean(value)) AS up FROM events GROUP BY time(1d), event_type", f"SELECT * FROM (SELECT time, event_type, round(m - lag(m) OVER w, 6) AS difference, round(CASE WHEN m >= lag(m) OVER w THEN m - lag(m) OVER w END, 6) AS up FROM {_DAILY} {_DAYS_W}) WHERE difference IS NOT NULL OR up IS NOT NULL", "difference", "up")
_ql("ql_derivative", "SELECT derivative(mean(value), 1h), non_negative_derivative(mean(value), 6h) AS up FROM events GROUP BY time(1d), event_type", f"SELECT * FROM (SELECT time, event_type, round((m - lag(m) OVER w) * 3600 / (epoch(time) - epoch(lag(time) OVER w)), 6) AS derivative, round(CASE WHEN m >= lag(m) OVER w THEN (m - lag(m) OVER w) * 21600 / (epoch(time) - epoch(lag(time) OVER w)) END, 6) AS up FROM {_DAILY} {_DAYS_W}) WHERE derivative IS NOT NULL OR up IS NOT NULL", "derivative", "up")
_ql("ql_moving_average", "SELECT moving_average(mean(value), 3) FROM events GROUP BY time(1d), event_type", f"SELECT * FROM (SELECT time, event_type, round(CASE WHEN count(m) OVER v = 3 THEN avg(m) OVER v END, 6) AS moving_average FROM {_DAILY} WINDOW v AS (PARTITION BY event_type ORDER BY time ROWS 2 PRECEDING)) WHERE moving_average IS NOT NULL", "moving_average")
_ql("ql_cumulative_sum", "SELECT cumulative_sum(sum(k)) FROM events GROUP BY time(1d), event_type", f"SELECT time, event_type, CAST(sum(s) OVER (PARTITION BY event_type ORDER BY time) AS BIGINT) AS cumulative_sum FROM (SELECT {_DAY} AS time, event_type, sum({_K}) AS s FROM events GROUP BY 1, 2)")
_ql("ql_elapsed", "SELECT elapsed(count(value), 1m) FROM events GROUP BY time(1h), event_type", f"SELECT * FROM (SELECT time, event_type, CAST(floor((epoch(time) - epoch(lag(time) OVER w)) / 60) AS BIGINT) AS elapsed FROM (SELECT DISTINCT {_HOUR} AS time, event_type FROM events) {_DAYS_W}) WHERE elapsed IS NOT NULL")
_ql("ql_top", "SELECT top(value, 3) FROM events GROUP BY event_type", "SELECT time, event_type, top FROM (SELECT ts AS time, event_type, value AS top, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts) AS n FROM events WHERE value IS NOT NULL) WHERE n <= 3")
_ql("ql_bottom", "SELECT bottom(value, 2) AS least FROM events GROUP BY time(7d), event_type", "SELECT time, event_type, least FROM (SELECT ts AS time, event_type, value AS least, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') ORDER BY value, ts) AS n FROM events WHERE value IS NOT NULL) WHERE n <= 2")
_ql("ql_mode", "SELECT mode(k) FROM events GROUP BY event_type", f"SELECT event_type, arg_min(k, (-n, k)) AS mode FROM (SELECT event_type, {_K} AS k, count(*) AS n FROM events WHERE {_K} IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
_ql("ql_regex_from", "SELECT count(event_id), count(o_orderkey) AS orders FROM /^(events|ord)/", "SELECT 'events' AS measurement, count(event_id) AS count, 0 AS orders FROM events UNION ALL SELECT 'orders', 0, count(o_orderkey) FROM orders")
_query("ql_into", f"SELECT {_DAY} AS time, event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")(lambda spark, sf_dir: _into(spark, sf_dir))


def _into(spark, sf_dir):
    c = Compiler(spark, catalog(spark, sf_dir), "metrics", "autogen", lambda: NOW)
    c.run('SELECT mean(value) INTO "short"."daily" FROM events GROUP BY time(1d), event_type')
    return _rounded(c.run('SELECT * FROM "short"."daily"'), "mean")


_BOUNDS = "WHERE time >= '2024-01-01T00:00:00Z' AND time < '2024-01-08T00:00:00Z'"
_GRID = f"""
WITH agg AS (
  SELECT time_bucket(INTERVAL '10 minutes', ts) AS time, event_type, avg(value) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08' GROUP BY 1, 2
), grid AS (
  SELECT event_type, g.time FROM (SELECT DISTINCT event_type FROM agg), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-07 23:50:00', INTERVAL '10 minutes')) AS time) g
), cells AS (SELECT grid.time, grid.event_type, m FROM grid LEFT JOIN agg USING (time, event_type))
"""
for _fill, _expr in {
    "null": "m",
    "zero": "coalesce(m, 0)",
    "previous": "last_value(m IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY time ROWS UNBOUNDED PRECEDING)",
}.items():
    _ql(f"ql_fill_{_fill}", f"SELECT mean(value) FROM events {_BOUNDS} GROUP BY time(10m), event_type FILL({'0' if _fill == 'zero' else _fill})", f"{_GRID} SELECT time, event_type, round({_expr}, 6) AS mean FROM cells", "mean")
_ql(
    "ql_fill_linear",
    f"SELECT mean(value) FROM events {_BOUNDS} GROUP BY time(10m), event_type FILL(linear)",
    _GRID
    + """, ends AS (
  SELECT *, last_value(m IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN m IS NOT NULL THEN epoch(time) END IGNORE NULLS) OVER b AS t0,
         first_value(m IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN m IS NOT NULL THEN epoch(time) END IGNORE NULLS) OVER a AS t1
  FROM cells WINDOW b AS (PARTITION BY event_type ORDER BY time ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
) SELECT time, event_type, round(CASE WHEN m IS NOT NULL THEN m ELSE v0 + (v1 - v0) * (epoch(time) - t0) / (t1 - t0) END, 6) AS mean FROM ends""",
    "mean",
)
_ql("ql_order_desc_offset", "SELECT value FROM events ORDER BY time DESC LIMIT 20 OFFSET 5", "SELECT ts AS time, value FROM events ORDER BY ts DESC, value LIMIT 20 OFFSET 5")
_ql("ql_limit_per_series", "SELECT value FROM events GROUP BY event_type ORDER BY time LIMIT 3 OFFSET 2", "SELECT ts AS time, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS n FROM events) WHERE n > 2 AND n <= 5")
_ql("ql_slimit", "SELECT mean(value) FROM events GROUP BY time(1d), event_type SLIMIT 2 SOFFSET 1", f"SELECT {_DAY} AS time, event_type, round(avg(value), 6) AS mean FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2 OFFSET 1) GROUP BY 1, 2", "mean")
_ql("ql_tz", "SELECT mean(value) FROM events GROUP BY time(1d) TZ('Etc/GMT-3')", f"SELECT CAST({_DAY} + INTERVAL '3 hours' AS TIMESTAMP) AS time, round(avg(value), 6) AS mean FROM events GROUP BY 1", "mean")
_ql("ql_multi_statement", "SELECT mean(value) FROM events GROUP BY event_type; SELECT count(o_totalprice) FROM orders GROUP BY o_orderstatus", "SELECT 0 AS statement, event_type, round(avg(value), 6) AS mean, CAST(NULL AS VARCHAR) AS o_orderstatus, CAST(NULL AS BIGINT) AS count FROM events GROUP BY event_type UNION ALL SELECT 1, NULL, NULL, o_orderstatus, count(o_totalprice) FROM orders GROUP BY o_orderstatus", "mean")
_ql("ql_qualified_names", 'SELECT count(l_tax) FROM "metrics"."short"."lineitem" GROUP BY l_returnflag', "SELECT l_returnflag, count(l_tax) AS count FROM lineitem GROUP BY 1")
_query("ql_now", "SELECT TIMESTAMP '2024-01-31 00:00:00' AS now")(lambda spark, sf_dir: run(spark, sf_dir, "SELECT now()").select(F.col("now").cast("timestamp_ntz").alias("now")))
_query("ql_sql_escape", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")(lambda spark, sf_dir: spark.sql("SELECT event_type, count(*) AS n FROM {t} GROUP BY 1", t=_table(spark, sf_dir, "events")))


@_query("ql_explain", "SELECT true AS filter_is_pushed, true AS columns_are_pruned")
def _explain(spark, sf_dir):
    """What EXPLAIN shows of the scan: the time filter reaches it, and only the columns in use are read."""
    plan = run(spark, sf_dir, "EXPLAIN SELECT mean(value) FROM events WHERE time > now() - 1d GROUP BY time(1h)")
    return plan.agg(F.max(F.col("plan").contains("GreaterThan(ts,")).alias("filter_is_pushed"), F.max(F.col("plan").contains("ReadSchema: struct<ts:timestamp_ntz,value:double>")).alias("columns_are_pruned"))


_query("ql_approximate", "SELECT event_type, true AS median_near, true AS percentile_near FROM events GROUP BY 1")(lambda spark, sf_dir: _approximate(spark, sf_dir))


def _approximate(spark, sf_dir):
    """Sketched quantiles lie among the exact ones of ranks nearby."""
    got = run(spark, sf_dir, "SELECT median_approx(value) AS m, percentile_approx(value, 90) AS p FROM events GROUP BY event_type")
    exact = run(spark, sf_dir, "SELECT percentile(value, 49) AS m0, percentile(value, 51) AS m1, percentile(value, 89) AS p0, percentile(value, 91) AS p1 FROM events GROUP BY event_type")
    return got.join(exact, "event_type").select("event_type", F.col("m").between(F.col("m0"), F.col("m1")).alias("median_near"), F.col("p").between(F.col("p0"), F.col("p1")).alias("percentile_near"))



# Metadata.

_query("met_databases", "VALUES ('metrics'), ('telegraf')".replace("VALUES", "SELECT * FROM (VALUES") + ") t(name)")(lambda spark, sf_dir: run(spark, sf_dir, "SHOW DATABASES"))
_query("met_measurements", "SELECT * FROM (VALUES ('events'), ('lineitem'), ('orders')) t(name)")(lambda spark, sf_dir: catalog(spark, sf_dir).show_measurements("metrics"))
_query("met_field_keys", """SELECT * FROM (VALUES ('events', 'event_id', 'integer'), ('events', 'k', 'integer'), ('events', 'value', 'float')) t(measurement, "fieldKey", "fieldType")""")(lambda spark, sf_dir: run(spark, sf_dir, "SHOW FIELD KEYS FROM events"))
_query("met_tag_keys", """SELECT * FROM (VALUES ('events', 'event_type'), ('events', 'user_id'), ('orders', 'o_orderpriority'), ('orders', 'o_orderstatus')) t(measurement, "tagKey")""")(lambda spark, sf_dir: run(spark, sf_dir, "SHOW TAG KEYS"))
_query("met_tag_values", "SELECT DISTINCT 'event_type' AS key, event_type AS value FROM events")(lambda spark, sf_dir: run(spark, sf_dir, "SHOW TAG VALUES FROM events WITH KEY = event_type"))
_ql("met_tag_values_all", "SHOW TAG VALUES WITH KEY IN (event_type, o_orderstatus)", "SELECT DISTINCT 'events' AS measurement, 'event_type' AS key, event_type AS value FROM events UNION ALL SELECT DISTINCT 'orders', 'o_orderstatus', o_orderstatus FROM orders")
_ql("met_series", "SHOW SERIES FROM orders", "SELECT DISTINCT 'orders,o_orderpriority=' || replace(o_orderpriority, ' ', '\\ ') || ',o_orderstatus=' || o_orderstatus AS key FROM orders")
_ql("met_series_cardinality_all", "SHOW SERIES CARDINALITY", "SELECT 'events' AS measurement, count(DISTINCT (event_type, user_id)) AS cardinality FROM events UNION ALL SELECT 'orders', count(DISTINCT (o_orderstatus, o_orderpriority)) FROM orders")
_query("met_ping", "SELECT true AS ok")(lambda spark, sf_dir: spark.range(1).select(F.lit(catalog(spark, sf_dir).ping()).alias("ok")))
_query("met_cell", "SELECT event_id, coalesce(event_type, CAST(user_id AS VARCHAR)) AS cell FROM events")(
    lambda spark, sf_dir: first_value(_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("Name"), F.col("user_id").cast("string").alias("NAME")), "name", "cell")
)
_query(
    "met_schema",
    """SELECT * FROM (VALUES ('events', 'field', 'event_id', 'integer'), ('events', 'field', 'k', 'integer'), ('events', 'field', 'value', 'float'), ('events', 'tag', 'event_type', ''), ('events', 'tag', 'user_id', ''),
    ('orders', 'field', 'o_orderkey', 'integer'), ('orders', 'field', 'o_totalprice', 'float'), ('orders', 'tag', 'o_orderpriority', ''), ('orders', 'tag', 'o_orderstatus', '')) t(measurement, kind, name, type)""",
)(lambda spark, sf_dir: catalog(spark, sf_dir).schema("metrics", "autogen"))
_query(
    "met_retention_policies",
    """SELECT * FROM (VALUES ('metrics', 'autogen', '0s', '168h0m0s', '1', true), ('metrics', 'short', '24h0m0s', '1h0m0s', '1', false), ('telegraf', 'raw', '720h0m0s', '24h0m0s', '1', true)) t(database, retention_policy, duration, shard_group_duration, replica_n, "default")""",
)(lambda spark, sf_dir: catalog(spark, sf_dir).show_retention_policies())
_ql("met_series_cardinality", "SHOW SERIES CARDINALITY FROM events", "SELECT count(DISTINCT (event_type, user_id)) AS cardinality FROM events")
_query("met_tag_cardinality", "SELECT 'event_type' AS tag, count(DISTINCT event_type) AS values_count FROM events UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events")(lambda spark, sf_dir: tag_cardinality(catalog(spark, sf_dir).lookup("metrics", None, "events"), 5))


@_query("met_schema_merge", "SELECT * FROM (VALUES ('a', 2, 1), ('b', 1, NULL), ('c', NULL, 1)) t(measurement, n_fields, n_tags)")
def _schema_merge(spark, sf_dir):
    f = spark.createDataFrame([("a", "y", "float"), ("a", "x", "float"), ("b", "x", "integer")], "measurement string, field string, type string")
    t = spark.createDataFrame([("a", "host"), ("c", "path")], "measurement string, tag string")
    m = merged_schema(f, t)
    return m.select("measurement", F.when(F.col("fields").isNotNull(), F.size("fields")).alias("n_fields"), F.when(F.col("tags").isNotNull(), F.size("tags")).alias("n_tags"))


# Normalization.


@_query(
    "nrm_table_union",
    "SELECT 'events' AS measurement, event_type, NULL AS o_orderstatus, time_bucket(INTERVAL '1 day', ts) AS time, round(avg(value), 6) AS value, NULL AS total FROM events GROUP BY 2, 4 UNION ALL SELECT 'orders', NULL, o_orderstatus, time_bucket(INTERVAL '30 days', o_orderdate, TIMESTAMP '1970-01-01'), NULL, round(sum(o_totalprice), 2) FROM orders GROUP BY 3, 4",
)
def _table_union(spark, sf_dir):
    a = _rounded(run(spark, sf_dir, "SELECT mean(value) AS value FROM events GROUP BY time(1d), event_type"), "value")
    b = _rounded(run(spark, sf_dir, "SELECT sum(o_totalprice) AS total FROM orders GROUP BY time(30d), o_orderstatus"), "total", digits=2)
    return series.union_tables([("events", a, ["event_type"]), ("orders", b, ["o_orderstatus"])])


_LINE_SERIES = "SELECT 'lineitem.' || field AS name, 'l_linestatus=' || l_linestatus || ',l_returnflag=' || l_returnflag AS label, l_shipdate AS time, value FROM (UNPIVOT (SELECT l_returnflag, l_linestatus, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME field VALUE value)"


@_query("nrm_series_unpivot", f"SELECT name || '{{' || label || '}}' AS label, time, count(*) AS n, round(sum(value), 4) AS total FROM ({_LINE_SERIES}) GROUP BY 1, 2")
def _series_unpivot(spark, sf_dir):
    s = series.grouped_points(_table(spark, sf_dir, "lineitem"), "lineitem", LINE_TAGS, LINE_FIELDS, "time", "l_shipdate")
    return s.select(text.series_label(F.col("name"), series.tag_map(LINE_TAGS)).alias("label"), "time", "n", F.round("sum", 4).alias("total"))


@_query("nrm_series_points", f"SELECT name, label, count(*) AS n, round(min(value), 4) AS low, count(DISTINCT time) AS times FROM ({_LINE_SERIES}) GROUP BY 1, 2")
def _series_points(spark, sf_dir):
    s = series.points(_table(spark, sf_dir, "lineitem"), "lineitem", LINE_TAGS, LINE_FIELDS, "l_shipdate").groupBy("name", "tag_0", "tag_1").agg(F.count("*").alias("n"), F.round(F.min("value"), 4).alias("low"), F.count_distinct("time").alias("times"))
    return _keyed(s.withColumn("tags", series.tag_map(LINE_TAGS))).select("name", F.col("tags_key").alias("label"), "n", "low", "times")


#: Order keys whose orders share a response body, for each status.
_BODY_KEYS = 5000


def _order_bodies(orders: DataFrame) -> DataFrame:
    """Response bodies of orders: one for each status and range of keys, so that bodies don't grow with the table."""
    cells = F.array(F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"')), F.col("o_totalprice").cast("string"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')))
    parts = orders.groupBy("o_orderstatus", F.expr(f"o_orderkey div {_BODY_KEYS}")).agg(F.array_join(F.collect_list(F.concat(F.lit("["), F.array_join(cells, ","), F.lit("]"))), ",").alias("rows"))
    return parts.select(F.format_string('{"results":[{"statement_id":0,"series":[{"name":"orders","tags":{"o_orderstatus":"%s"},"columns":["time","value","note"],"values":[%s]}]}]}', "o_orderstatus", "rows").alias("body"))


@_query("nrm_wire_series", "SELECT 'orders' AS name, o_orderstatus AS tag, epoch_ns(o_orderdate) AS time_ns, round(o_totalprice, 6) AS value FROM orders")
def _wire_series(spark, sf_dir):
    """Orders as response bodies, built and read back."""
    body = _order_bodies(_table(spark, sf_dir, "orders"))
    return wire.normalize(body).series.select("name", F.col("tags")["o_orderstatus"].alias("tag"), "time_ns", F.round("value", 6).alias("value"))


#: A response with two statements, tags that differ, a column that hides a tag, rows short and long, a series without rows.
_ODD_BODY = """{"results": [
  {"statement_id": 0, "series": [{"name": "tide", "tags": {"port": "brest", "zone": "w"}, "columns": ["time", "port", "height"], "values": [["2019-03-21T12:00:00Z"], ["2019-03-21T12:10:00Z", "cell", 4.5, "more"], ["never", null, 2]]}]},
  {"statement_id": 1, "series": [{"name": "wind", "tags": {"mast": "m"}, "columns": ["time", "gust"], "values": []}, {"name": "swell", "columns": ["time", "value"], "values": [["2019-03-21T13:00:00Z", 7], [null, 8]]}]}]}"""


def _odd(spark: SparkSession) -> wire.Response:
    return wire.normalize(spark.createDataFrame([(_ODD_BODY,)], "body string"))


_query(
    "nrm_wire_table",
    """SELECT * FROM (VALUES ('0', 'tide', NULL, 'brest', 'w', '2019-03-21T12:00:00Z', NULL, NULL, NULL), ('0', 'tide', NULL, 'cell', 'w', '2019-03-21T12:10:00Z', '4.5', NULL, NULL), ('0', 'tide', NULL, 'brest', 'w', 'never', '2', NULL, NULL),
    ('1', 'swell', NULL, NULL, NULL, '2019-03-21T13:00:00Z', NULL, NULL, '7'), ('1', 'swell', NULL, NULL, NULL, NULL, NULL, NULL, '8')) t(statement, measurement, mast, port, zone, time, height, gust, value)""",
)(lambda spark, sf_dir: _odd(spark).table)
_query("nrm_wire_points", "SELECT * FROM (VALUES ('tide.height', 'brest', 1553170200000000000, 4.5), ('swell', NULL, 1553173200000000000, 7.0)) t(name, port, time_ns, value)")(
    lambda spark, sf_dir: _odd(spark).series.select("name", F.col("tags")["port"].alias("port"), "time_ns", F.col("value").cast("double").alias("value"))
)
_query("nrm_wire_counters", "SELECT 'series' AS kind, 2 AS statements, 5 AS rows, 2 AS points, 2 AS series")(lambda spark, sf_dir: (lambda r: spark.createDataFrame([(r.kind(), *(r.counters()[k] for k in ("statements", "rows", "points", "series")))], "kind string, statements int, rows int, points int, series int"))(_odd(spark)))


@_query("nrm_wire_error", "SELECT * FROM (VALUES ('closed'), ('no such port')) t(message)")
def _wire_error(spark, sf_dir):
    """A response with an error, of a statement or of the whole, gives no table."""
    said = []
    for text_ in ('{"results": [{"series": []}, {"error": "no such port"}]}', '{"error": "closed"}'):
        try:
            wire.normalize(spark.createDataFrame([(text_,)], "body string"))
        except wire.WireError as e:
            said.append((str(e),))
    return spark.createDataFrame(said, "message string")


# Summaries, downsampling, chart geometry.



def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("tags_key", F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@_query("sum_series_stats", f"SELECT name, label AS tags_key, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 6) AS avg_value, count(*) AS points FROM ({_LINE_SERIES}) GROUP BY 1, 2")
def _series_stats(spark, sf_dir):
    s = series.grouped_points(_table(spark, sf_dir, "lineitem"), "lineitem", LINE_TAGS, LINE_FIELDS, None, "l_shipdate")
    s = s.select("name", series.tag_map(LINE_TAGS).alias("tags"), F.col("low").alias("min_value"), F.col("high").alias("max_value"), (F.col("sum") / F.col("n")).alias("avg_value"), F.col("n").alias("points"))
    return _rounded(_keyed(s).drop("tags"), "min_value", "max_value", "avg_value")


_query("sum_time_range", "SELECT min(ts) AS time_from, max(ts) AS time_to FROM events")(lambda spark, sf_dir: series.time_range(_table(spark, sf_dir, "events"), "ts"))

_WIDTH = 60
_REDUCED = f"""SELECT event_type, bucket, avg(value) AS value, count(*) AS points FROM (
  SELECT event_type, value, CASE WHEN n <= {_WIDTH} THEN i ELSE ((i + 1) * {_WIDTH} - 1) // n END AS bucket FROM (
    SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)) GROUP BY 1, 2"""
_SCALED = f"SELECT r.event_type, bucket, round(r.value, 6) AS value, points, CAST(least(7, greatest(0, 7 - round((r.value - low) / (high - low) * 7))) AS INTEGER) AS row FROM ({_REDUCED}) r JOIN (SELECT event_type, min(value) AS low, max(value) AS high FROM events GROUP BY 1) e USING (event_type)"


def _reduced(spark, sf_dir):
    return series.downsample(_table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], _WIDTH)


_query("win_downsample", f"SELECT event_type, bucket, round(value, 6) AS value, points FROM ({_REDUCED})")(lambda spark, sf_dir: _rounded(_reduced(spark, sf_dir), "value"))
_query("win_spark_levels", f"SELECT event_type, bucket, round(value, 6) AS value, points, CAST(round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 7) AS INTEGER) AS level FROM ({_REDUCED}) WINDOW w AS (PARTITION BY event_type)")(
    lambda spark, sf_dir: _rounded(series.levels(_reduced(spark, sf_dir), ["event_type"]), "value")
)


def _rows(spark, sf_dir):
    return series.chart_rows(_reduced(spark, sf_dir), _table(spark, sf_dir, "events"), ["event_type"])


_query("win_chart_rows", _SCALED)(lambda spark, sf_dir: _rounded(_rows(spark, sf_dir), "value"))
_query("win_chart_connect", f"SELECT *, CASE WHEN prev_row IS NULL THEN 0 ELSE greatest(0, abs(row - prev_row) - 1) END AS gap FROM (SELECT *, lag(row) OVER (PARTITION BY event_type ORDER BY bucket) AS prev_row FROM ({_SCALED}))")(
    lambda spark, sf_dir: _rounded(series.chart_connect(_rows(spark, sf_dir), ["event_type"]), "value").withColumn("gap", F.coalesce("gap", F.lit(0)))
)
_query("lim_first_series", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY min(event_id) LIMIT 3) GROUP BY 1")(
    lambda spark, sf_dir: series.first_series(_table(spark, sf_dir, "events"), ["event_type"], 3, ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))
)

# Scalar functions.

_query("fn_epoch_encode", "SELECT event_id, epoch_ns(ts) AS ns, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, epoch_us(ts) // 60000000 AS m, epoch_us(ts) // 3600000000 AS h FROM events")(
    lambda spark, sf_dir: _table(spark, sf_dir, "events").select("event_id", *(epoch.encode(F.col("ts"), u).alias("us" if u == "u" else u) for u in ("ns", "u", "ms", "s", "m", "h")))
)
_query("fn_epoch_decode", "SELECT event_id, CAST(make_timestamp(event_id * 1000000) AS TIMESTAMP) AS s, CAST(make_timestamp(event_id * 1000) AS TIMESTAMP) AS ms, CAST(make_timestamp(event_id * 3600000000) AS TIMESTAMP) AS h, event_id * 500000000 AS half_ns FROM events")(
    lambda spark, sf_dir: _table(spark, sf_dir, "events").select(
        "event_id", *(epoch.to_time(F.col("event_id"), u).cast("timestamp_ntz").alias(u) for u in ("s", "ms", "h")), epoch.text_to_ns(F.concat((F.col("event_id") / 2).cast("decimal(20,1)").cast("string"), F.lit("e0")), "s").alias("half_ns")
    )
)
_query("fn_line_protocol", "SELECT event_id, 'events,event_type=' || event_type || ',user=' || user_id || ' value=' || printf('%.3f', floor(value * 10) / 10) || ',id=' || event_id || 'i ' || epoch_us(ts) // 1000 AS line FROM events")(
    lambda spark, sf_dir: (
        lambda e: e.select("event_id", lineproto.line("events", ["event_type", "user"], ["value", "id"], e, "ms").alias("line"))
    )(_table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("user"), (F.floor(F.col("value") * 10) / 10).alias("value"), F.col("event_id").alias("id"), (epoch.micros(F.col("ts")) * 1000).alias("time_ns")))
)
_query("fn_line_escape", r"""SELECT doc_id, replace(replace(replace(text, '\', '\\'), ',', '\,'), ' ', '\ ') AS measurement, replace(replace(replace(replace(text, '\', '\\'), ',', '\,'), ' ', '\ '), '=', '\=') AS tag, '"' || replace(replace(text, '\', '\\'), '"', '\"') || '"' AS field FROM documents""")(
    lambda spark, sf_dir: (lambda t: _table(spark, sf_dir, "documents").select("doc_id", text.escape_measurement(t).alias("measurement"), text.escape_key(t).alias("tag"), text.quote_field(t).alias("field")))(F.col("text"))
)
_query("fn_series_label", "SELECT DISTINCT 'orders{priority=' || o_orderpriority || ',status=' || o_orderstatus || '}' AS label FROM orders")(
    lambda spark, sf_dir: _table(spark, sf_dir, "orders").select(text.series_label(F.lit("orders"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")).alias("label")).distinct()
)
_query("fn_sanitize", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS clean FROM documents")(lambda spark, sf_dir: _table(spark, sf_dir, "documents").select("doc_id", text.sanitize(F.col("text")).alias("clean")))


@_query("src_line_parse", "SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, event_id AS id, round(value, 3) AS value, epoch_us(ts) // 1000 AS ms FROM events")
def _line_parse(spark, sf_dir):
    """Lines of all events, read back."""
    e = _table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("user_id"), F.round("value", 3).alias("value"), F.col("event_id").alias("id"), (epoch.micros(F.col("ts")) * 1000).alias("time_ns"))
    p = lineproto.parse(e.select("event_id", lineproto.line("events", ["event_type", "user_id"], ["value", "id"], e, "ms").alias("line")), "ms")
    return p.select("event_id", F.col("tags")["event_type"].alias("event_type"), F.col("tags")["user_id"].alias("user_id"), lineproto.typed(F.col("fields")["id"], "integer").alias("id"), F.round(lineproto.typed(F.col("fields")["value"], "float"), 3).alias("value"), F.expr("time_ns div 1000000").alias("ms"))


@_query("src_line_bad_rows", "SELECT n, CASE n % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'a b' WHEN 2 THEN 'cpu' END AS measurement, CASE n % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'c,d' WHEN 2 THEN '1' END AS host, CASE WHEN n % 4 <> 3 THEN n END AS time_ns FROM (SELECT event_id AS n FROM events)")
def _line_bad_rows(spark, sf_dir):
    """Lines with a repeated tag, escapes, a quoted field and no fields at all, in turn."""
    n = F.col("event_id")
    stamp = F.concat(F.lit(" "), n.cast("string"))
    kinds = [F.concat(F.lit("cpu,host=x,host=y v=1,v=2"), stamp), F.concat(F.lit("a\\ b,host=c\\,d v=1"), stamp), F.concat(F.lit('cpu,host=1 note="x y,z=\\"q\\""'), stamp), F.lit("cpu")]
    line = F.when(n % 4 == 0, kinds[0]).when(n % 4 == 1, kinds[1]).when(n % 4 == 2, kinds[2]).otherwise(kinds[3])
    p = lineproto.parse(_table(spark, sf_dir, "events").select(n.alias("n"), line.alias("line")))
    return p.select("n", "measurement", F.col("tags")["host"].alias("host"), "time_ns")


# Generators.


def _gen(spark: SparkSession, dataset: str, **how) -> DataFrame:
    return datasets.generate(spark, datasets.plan(datasets.Options(dataset, start_ns=START_NS, **how)))


_REGION = "list_extract(['us-east', 'us-west', 'eu-central', 'ap-south'], CAST({} % 4 + 1 AS BIGINT))"
_query("gen_demo_cpu", f"SELECT i AS seq, printf('host-%04d', i % 10) AS host, {_REGION.format('(i % 10)')} AS region, 'cpu-total' AS cpu, round(15 + 45 * abs(sin(i / 17)), 6) AS usage_user, round(5 + 12 * abs(cos(i / 29)), 6) AS usage_system, round(greatest(0, 100 - (15 + 45 * abs(sin(i / 17))) - (5 + 12 * abs(cos(i / 29)))), 6) AS usage_idle, {START_NS} + i * 10000000 AS time_ns, i // 5000 AS batch FROM range(6000) t(i)")(
    lambda spark, sf_dir: _rounded(_gen(spark, "demo-cpu"), "usage_user", "usage_system", "usage_idle")
)
_query("gen_high_cardinality", f"SELECT i AS seq, printf('host-%04d', i % 20) AS host, printf('pid-%08d', i // 20 % 50) AS pid, printf('svc-%02d', i // 20 % 50 % 64) AS service, {_REGION.format('(i % 20)')} AS region, round((i * 37 % 1000) / 10, 6) AS value, {START_NS} + i * 10000000 AS time_ns, i // 5000 AS batch FROM range(6000) t(i)")(
    lambda spark, sf_dir: _rounded(_gen(spark, "high-cardinality", hosts=20, pids=50), "value")
)
_query("gen_out_of_order", f"SELECT i AS seq, printf('host-%04d', i % 10) AS host, {_REGION.format('(i % 10)')} AS region, round(50 + 30 * sin(i / 11), 6) AS usage_idle, {START_NS} + (CASE WHEN i >= 100 AND i % 10 = 0 THEN i - 100 ELSE i END) * 10000000 AS time_ns, i // 5000 AS batch FROM range(6000) t(i)")(
    lambda spark, sf_dir: _rounded(_gen(spark, "out-of-order", ratio=0.1), "usage_idle")
)
_query("gen_covering_block", f"SELECT i AS seq, printf('host-%04d', k % 10) AS host, {_REGION.format('(k % 10)')} AS region, round(35 + (i * 19 % 500) / 10, 6) AS usage_idle, {START_NS} + k * 10000000 AS time_ns, i // 5000 AS batch FROM (SELECT i, CASE WHEN i < 4200 THEN i ELSE (i - 4200) % 840 END AS k FROM range(6000) t(i))")(
    lambda spark, sf_dir: _rounded(_gen(spark, "covering-block"), "usage_idle")
)
_query("gen_stress_basic", f"SELECT i AS seq, 'server-' || (i % 500) AS host, 'us-west' AS location, CAST(i * 37 % 1000 AS DOUBLE) AS value, {START_NS} + (i // 500 + 1) * 10000000000 AS time_ns, i // 5000 AS batch FROM range(10000) t(i)")(
    lambda spark, sf_dir: _gen(spark, "stress-basic", points=20, series=500)
)


@_query("gen_lines", f"SELECT i AS seq, i // 5000 AS batch, 'cpu,host=server-' || (i % 500) || ',location=us-west value=' || (i * 37 % 1000) || '.000 ' || ({START_NS // 10**9} + (i // 500 + 1) * 10) AS line FROM range(10000) t(i)")
def _gen_lines(spark, sf_dir):
    p = datasets.plan(datasets.Options("stress-basic", start_ns=START_NS, points=20, series=500, precision="s"))
    return datasets.lines(datasets.generate(spark, p), p)


_IQL_CARTESIAN = "SET Database [iqldb]\nSET Precision [s]\nSET StartDate [2006-01-02]\nINSERT\ncpu,host=server-[int inc(0) 4],\nregion=[east|west|north]\nvalue=[int inc(1) 0]\n5000 10s\n"
_IQL_CYCLE = "SET Precision [s]\nSET StartDate [2006-01-02]\nGO INSERT\nload,kind=[a|b]\nlevel=[low|mid|high],step=[float inc(10) 4],n=[int inc(5) 0]\n3000 1m\n"
_query("gen_iql_cartesian", "SELECT i AS seq, 'cpu,host=server-' || (i % 4) || 'i,region=' || list_extract(['east', 'west', 'north'], CAST(i // 4 % 3 + 1 AS BIGINT)) || ' value=' || (1 + i // 12) || 'i ' || (1136160000 + 10 * (i // 12)) AS line, i // 5000 AS batch FROM range(5000) t(i)")(
    lambda spark, sf_dir: iql.run(spark, _IQL_CARTESIAN).lines.select("seq", "line", "batch")
)
_query("gen_iql_cycle", "SELECT i AS seq, 'load,kind=' || list_extract(['a', 'b'], CAST(i % 2 + 1 AS BIGINT)) || ' level=' || list_extract(['low', 'mid', 'high'], CAST(i % 3 + 1 AS BIGINT)) || ',step=' || (10 + i % 4) || ',n=' || (5 + i // 2) || 'i ' || (1136160000 + 60 * (i // 2)) AS line, i // 5000 AS batch FROM range(3000) t(i)")(
    lambda spark, sf_dir: iql.run(spark, _IQL_CYCLE).lines.select("seq", "line", "batch")
)
_query("gen_iql_rand", "SELECT true AS below, true AS letters, true AS varied, true AS repeatable")(lambda spark, sf_dir: _iql_rand(spark))


def _iql_rand(spark):
    """Random values keep to their ranges, differ, and are the same in every run."""
    script = "SET Precision [s]\nSET StartDate [2006-01-02]\nINSERT\nload,kind=[a|b]\nn=[int rand(50) 0],s=[str rand(8) 0]\n2000 1m\n"
    rows = [iql.run(spark, script).lines.select("seq", F.regexp_extract("line", r" n=(\d+)i", 1).cast("int").alias("n"), F.regexp_extract("line", r"s=\W?([a-z0-9]{8})\b", 1).alias("s")) for _ in range(2)]
    same = rows[0].exceptAll(rows[1]).agg((F.count("*") == 0).alias("repeatable"))
    return rows[0].agg(F.min(F.col("n").between(0, 49)).alias("below"), F.min(F.length("s") == 8).alias("letters"), ((F.count_distinct("n") > 40) & (F.count_distinct("s") > 1900)).alias("varied")).join(same)


_query("batch_counts", "SELECT i // 750 AS batch, count(*) AS points, min(i) AS first_seq FROM range(6000) t(i) GROUP BY 1")(
    lambda spark, sf_dir: _gen(spark, "demo-cpu", batch_size=750).groupBy("batch").agg(F.count("*").alias("points"), F.min("seq").alias("first_seq"))
)

# Late and rewritten data.

_query("ooo_detect", f"SELECT seq, host, time_ns, previous_time FROM (SELECT i AS seq, i % 7 AS host, t AS time_ns, lag(t) OVER (PARTITION BY i % 7 ORDER BY i) AS previous_time FROM (SELECT i, {START_NS} + (CASE WHEN i >= 100 AND i % 10 = 0 THEN i - 100 ELSE i END) * 10000000 AS t FROM range(6000) r(i))) WHERE time_ns < previous_time")(
    lambda spark, sf_dir: series.out_of_order(_gen(spark, "out-of-order", ratio=0.1).select("seq", (F.col("seq") % 7).alias("host"), "time_ns"), ["host"], "seq", "time_ns")
)
_query("covering_dedup", f"SELECT host, time_ns, max(i) AS seq, round(arg_max(v, i), 6) AS usage_idle FROM (SELECT i, printf('host-%04d', k % 10) AS host, {START_NS} + k * 10000000 AS time_ns, 35 + (i * 19 % 500) / 10 AS v FROM (SELECT i, CASE WHEN i < 4200 THEN i ELSE (i - 4200) % 840 END AS k FROM range(6000) t(i))) GROUP BY 1, 2")(
    lambda spark, sf_dir: _rounded(series.last_write_wins(_gen(spark, "covering-block").select("host", "time_ns", "seq", "usage_idle"), ["host", "time_ns"], "seq"), "usage_idle")
)

# Completion and history over tables.

_query("cmp_prefix", "SELECT DISTINCT p_brand AS candidate FROM part WHERE lower(p_brand) LIKE 'brand#1%'")(
    lambda spark, sf_dir: _table(spark, sf_dir, "part").where(F.lower("p_brand").startswith("brand#1")).select(F.col("p_brand").alias("candidate")).distinct().orderBy("candidate")
)
_query("hist_search", "SELECT conv_id, turn, role, text FROM conversations WHERE contains(lower(text), 'tion') OR contains(lower(role), 'tion') ORDER BY conv_id DESC, turn DESC LIMIT 20")(
    lambda spark, sf_dir: history.latest(history.matching(_table(spark, sf_dir, "conversations"), "TION", ["text", "role"]), ["conv_id", "turn"]).select("conv_id", "turn", "role", "text")
)
_query("hist_search_joined", "SELECT conv_id, turn FROM conversations WHERE contains(lower(concat_ws(' ', role, text)), 'user t') ORDER BY conv_id DESC, turn DESC LIMIT 20")(
    lambda spark, sf_dir: history.latest(history.matching_joined(_table(spark, sf_dir, "conversations"), "user t", ["role", "text"]), ["conv_id", "turn"]).select("conv_id", "turn")
)

# Streams, run to their end.

_query("stream_hourly_counts", f"SELECT {_HOUR} AS time, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")(
    lambda spark, sf_dir: _rounded(twins.drained(twins.bucket_counts(twins.file_stream(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value"), "complete"), "total")
)
_query("stream_sessions", "SELECT event_type, CAST(min(ts) AS TIMESTAMP) AS session_start, CAST(max(ts) + INTERVAL '90 seconds' AS TIMESTAMP) AS session_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL '90 seconds' THEN 0 ELSE 1 END AS new FROM events WHERE event_type <> 'view')) GROUP BY event_type, session")(
    lambda spark, sf_dir: twins.drained(twins.sessions(twins.file_stream(spark, sf_dir, "events").where("event_type <> 'view'").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "90 seconds", ["event_type"], "1 hour"), "complete").select("event_type", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")
)
_query("watch_snapshot", "SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1")(
    lambda spark, sf_dir: twins.drained(twins.file_stream(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest")), "complete")
)
_query("stream_dedup", "SELECT DISTINCT event_type, user_id FROM events")(
    lambda spark, sf_dir: twins.drained(twins.newest_once(twins.file_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "60 days", ["event_type", "user_id"]).select("event_type", "user_id"), "append")
)
