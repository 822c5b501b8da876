"""Line protocol: lines from rows, and rows from lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.epoch import UNIT_NS, precision
from ..functions.text import escape_key, escape_measurement, quote_field


def field_value(c: Column, kind: str) -> Column:
    """Floats with three decimals, integers with i, text in quotes, booleans as words."""
    if kind in ("double", "float") or kind.startswith("decimal"):
        return F.format_string("%.3f", c.cast("double"))
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.concat(c.cast("string"), F.lit("i"))
    if kind == "boolean":
        return F.when(c, "true").otherwise("false")
    return quote_field(c.cast("string"))


def line(measurement: str, tags: list[str], fields: list[str], df: DataFrame, unit: str = "ns", time_ns: str = "time_ns") -> Column:
    """measurement,tag=value,... field=value,... time; null and empty tags and null fields are left out."""
    kinds = dict(df.dtypes)
    head = F.concat_ws(",", escape_measurement(F.lit(measurement)), *(F.when(F.col(t) != "", F.concat(escape_key(F.lit(t)), F.lit("="), escape_key(F.col(t).cast("string")))) for t in tags))
    body = F.concat_ws(",", *(F.when(F.col(f).isNotNull(), F.concat(escape_key(F.lit(f)), F.lit("="), field_value(F.col(f), kinds[f]))) for f in fields))
    ns = UNIT_NS[precision(unit)]
    stamp = F.col(time_ns) if ns == 1 else F.floor(F.col(time_ns) / F.lit(ns).cast("decimal(20,0)")).cast("long")
    return F.concat_ws(" ", head, body, stamp.cast("string"))


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([,= \\])", "$1")


#: A line without escapes and quotes, whose pairs are all complete.
PLAIN = r"^[^\\\", ]++(?:,[^\\\",= ]++=[^\\\", ]++)*+ [^\\\",= ]++=[^\\\", ]++(?:,[^\\\",= ]++=[^\\\", ]++)*+(?: -?\d++)?$"
#: A key that comes again in the same part of a line.
AGAIN = r"[ ,]([^,= ]++)=[^, ]*+(?:,[^,= ]++=[^, ]*+)*?,\1="


def parse(lines: DataFrame, unit: str = "ns", column: str = "line") -> DataFrame:
    """measurement, tags (map), fields (map of text as written) and time_ns of each line; blank lines and comments are left out, and what doesn't parse has a null measurement. Of a key that comes again, the last value counts.

    Lines without escapes, quotes and repeated keys - one expression tells - are split; only the others are taken apart
    by regular expressions.
    """
    raw = F.trim(F.col(column))
    shape = r"^((?:\\.|[^\\ ])+) ((?:\\.|\"(?:\\.|[^\"\\])*\"|[^\\ \"])+)(?: (-?\d+))?$"
    rows = lines.where((raw != "") & ~raw.startswith("#")).withColumn("__l", raw).withColumn("__plain", F.col("__l").rlike(PLAIN) & ~F.col("__l").rlike(AGAIN))
    part = lambda k: F.when(F.col("__plain"), F.split_part("__l", F.lit(" "), F.lit(k))).otherwise(F.regexp_extract("__l", shape, k))
    rows = rows.withColumns({"__head": part(1), "__body": part(2), "__time": part(3)})
    pair = r"((?:\\.|[^\\,= ])+)=(\"(?:\\.|[^\"\\])*\"|(?:\\.|[^\\, ])+)"

    def pairs(c: Column, clean_value) -> Column:
        keys = F.transform(F.regexp_extract_all(c, F.lit(pair), F.lit(1)), _unescape)
        values = F.transform(F.regexp_extract_all(c, F.lit(pair), F.lit(2)), clean_value)
        entries = F.arrays_zip(keys.alias("key"), values.alias("value"))
        last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
        return F.map_from_entries(last)

    none = F.expr("CAST(map() AS map<string,string>)")
    comma = F.instr("__head", ",")
    plain_tags = F.when(comma > 0, F.str_to_map(F.substr("__head", comma + 1), F.lit(","), F.lit("="))).otherwise(none)
    name = F.when(F.col("__plain"), F.substring_index("__head", ",", 1)).otherwise(_unescape(F.regexp_extract("__head", r"^((?:\\.|[^\\,])+)", 1)))
    tags = F.when(F.col("__plain"), plain_tags).otherwise(pairs(F.regexp_extract("__head", r"^(?:\\.|[^\\,])+,(.*)$", 1), _unescape))
    fields = F.when(F.col("__plain"), F.str_to_map("__body", F.lit(","), F.lit("="))).otherwise(pairs(F.col("__body"), lambda v: v))
    ns = F.try_multiply(F.col("__time").try_cast("long"), F.lit(UNIT_NS[precision(unit)]).cast("long"))
    ok = (F.col("__head") != "") & F.col("__body").contains("=")
    keep = [c for c in lines.columns if c != column]
    return rows.select(*keep, F.when(ok, name).alias("measurement"), tags.alias("tags"), fields.alias("fields"), ns.alias("time_ns"))


def typed(value: Column, kind: str) -> Column:
    """A field's text as a value of its type; null if it is of another."""
    if kind == "integer":
        return F.when(value.rlike(r"^-?\d+i$"), F.rtrim(value, F.lit("i")).try_cast("long"))
    if kind == "float":
        return F.when(value.rlike(r"^[-+0-9.eE]+$"), value.try_cast("double"))
    if kind == "boolean":
        return F.when(F.lower(value).isin("t", "true"), True).when(F.lower(value).isin("f", "false"), False)
    return F.when(value.startswith('"'), F.regexp_replace(F.regexp_replace(value, '^"|"$', ""), r'\\(["\\])', "$1"))


def write(lines: DataFrame, root: str, database: str, policy: str = "autogen", unit: str = "ns") -> None:
    """Lines appended as Parquet under root/database/policy, partitioned by measurement; a database is needed, blank input is no write."""
    if not database:
        raise ValueError("database is required")
    rows = parse(lines, unit).where("measurement IS NOT NULL")
    rows.select("measurement", "tags", "fields", "time_ns").write.mode("append").partitionBy("measurement").parquet(f"{root}/{database}/{policy}")


def read(spark: SparkSession, root: str, database: str, policy: str, measurement: str, tags: list[str], fields: dict[str, str]) -> DataFrame:
    """A measurement as written, wide: time, time_ns, tags and typed fields."""
    rows = spark.read.parquet(f"{root}/{database}/{policy}").where(F.col("measurement") == measurement)
    return rows.select(F.timestamp_micros(F.floor(F.col("time_ns") / F.lit(1000).cast("decimal(20,0)")).cast("long")).alias("time"), "time_ns", *(F.col("tags")[t].alias(t) for t in tags), *(typed(F.col("fields")[f], k).alias(f) for f, k in fields.items()))
