"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests.

DataFrame functions only. Each distinct (host, path) of the input is expanded into the expressions that a rule could
have: one host suffix for each number of labels and one path prefix for each length that occurs among the rules (both
are bounded by the longest URL a rule may have, and are all that the driver gathers). Expressions meet rules by an
equi-join on the first 4 bytes of a SHA-256 digest; the whole digest confirms; the longest rule (host and path
together, then the longer host) wins. The verdicts of matched keys then join the rows themselves by a plain equi-join,
whose hot keys adaptive execution may split.

Nulls and odd input: a null url, or one without "://", has an empty host and path and no rule. Rows are never merged
or lost, repeated rows stay, an empty table gives an empty table. Columns of the input with the names of the result
(host, path, rule, verdict) are replaced. Of repeated rules the greatest verdict counts ("block" over "allow"); rules
with a null host or path are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, replacing

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that rules and expressions are joined on.
PREFIX_HEX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.lit(2**31 - 1))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _labels(host: Column) -> Column:
    return F.split(host, "\\.")


def matching_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """For distinct (host, path) keys, those that a rule fits: host, path, rule, verdict."""
    clean = (
        rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .dropna(subset=["r_host", "r_path"])
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_HEX))
    )
    shape = clean.agg(F.collect_set(F.size(_labels(F.col("r_host")))).alias("k"), F.collect_set(F.char_length("r_path")).alias("n")).first()
    if not shape["k"]:
        return keys.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).where("false")
    parts = _labels(F.col("host"))
    hosts = [F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in sorted(shape["k"])]
    paths = [F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["n"])]
    expressions = (
        keys.withColumn("e_host", F.explode(F.array_compact(F.array(*hosts))))
        .withColumn("e_path", F.explode(F.array_compact(F.array(*paths))))
        .withColumn("e_digest", _digest(F.col("e_host"), F.col("e_path")))
        .withColumn("e_prefix", F.substring("e_digest", 1, PREFIX_HEX))
    )
    sure = expressions.join(clean, expressions["e_prefix"] == clean["r_prefix"]).where(F.col("e_digest") == F.col("r_digest"))
    order = F.struct(F.char_length("r_host") + F.char_length("r_path"), F.char_length("r_host"))
    best = sure.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (host and path of the rule that wins, or null) and verdict (the rule's, else `default`)."""
    h, p = fresh(pages, "host"), fresh(pages, "path")
    host, path = host_and_path(F.col(url_column))
    rows = pages.withColumn(h, host).withColumn(p, path)
    keys = rows.select(F.col(h).alias("host"), F.col(p).alias("path")).where("host <> ''").distinct()
    found = matching_rules(keys, rules).select(F.col("host").alias("f_host"), F.col("path").alias("f_path"), F.col("rule").alias("f_rule"), F.col("verdict").alias("f_verdict"))
    f = {c: fresh(rows, c) for c in found.columns}
    found = found.select(*(F.col(c).alias(n) for c, n in f.items()))
    joined = rows.join(found, (F.col(h) == F.col(f["f_host"])) & (F.col(p) == F.col(f["f_path"])), "left")
    new = {"host": F.col(h), "path": F.col(p), "rule": F.col(f["f_rule"]), "verdict": F.coalesce(F.col(f["f_verdict"]), F.lit(default))}
    return replacing(joined, new).drop(h, p, *f.values())
