"""Databases, retention policies and measurements: a registry of lazy DataFrames whose columns have roles.

A measurement is a DataFrame with a column `time`, string tags and typed fields; roles live in the catalog and in the
metadata of the columns. The registry's own tables (databases, policies, fields, tags) are small and given as
DataFrames, sorted as their listings are.
"""

from __future__ import annotations

import re
import time as clock
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_key, escape_measurement

#: Field types by Spark type.
FIELD_TYPES = {"double": "float", "float": "float", "bigint": "integer", "int": "integer", "smallint": "integer", "string": "string", "boolean": "boolean"}


@dataclass(frozen=True)
class RetentionPolicy:
    name: str
    duration: str = "0s"
    shard_group_duration: str = "168h0m0s"
    replica_n: str = "1"
    default: bool = False


@dataclass
class Measurement:
    name: str
    df: DataFrame
    tags: list[str]
    fields: dict[str, str]

    def columns(self) -> list[str]:
        """time, then tags and fields by name."""
        return ["time", *sorted([*self.tags, *self.fields])]


@dataclass
class Database:
    policies: dict[str, RetentionPolicy] = field(default_factory=dict)
    measurements: dict[tuple[str, str], Measurement | Callable[[], Measurement]] = field(default_factory=dict)


class Catalog:
    def __init__(self, spark: SparkSession, ttl: float = 60.0):
        self.spark, self.databases, self.ttl = spark, {}, ttl
        self._cache: dict[tuple, tuple[float, object]] = {}

    def create_database(self, name: str, policies: list[RetentionPolicy] | None = None) -> None:
        db = self.databases.setdefault(name, Database())
        for p in policies if policies is not None else [RetentionPolicy("autogen", default=True)]:
            db.policies[p.name] = p

    def register(self, database: str, policy: str, name: str, df: DataFrame, time: str, tags: list[str], fields: list[str]) -> Measurement:
        """df becomes a measurement: `time` is renamed, tags become strings, field types follow Spark's."""
        m = _measurement(name, df, time, tags, fields)
        self._put(database, policy, name, m)
        return m

    def register_later(self, database: str, policy: str, name: str, make: Callable[[], DataFrame], time: str, tags: list[str], fields: list[str]) -> None:
        """As register; the DataFrame is made when the measurement is first looked up."""
        self._put(database, policy, name, lambda: _measurement(name, make(), time, tags, fields))

    def _put(self, database: str, policy: str, name: str, m: Measurement | Callable[[], Measurement]) -> None:
        if database not in self.databases:
            self.create_database(database)
        self.databases[database].measurements[policy, name] = m
        self.refresh()

    def _get(self, database: str, policy: str, name: str) -> Measurement:
        ms = self.databases[database].measurements
        if not isinstance(ms[policy, name], Measurement):
            ms[policy, name] = ms[policy, name]()
        return ms[policy, name]

    def drop_database(self, name: str) -> None:
        self.databases.pop(name, None)
        self.refresh()

    def drop_measurement(self, database: str | None, name: str) -> None:
        """From all policies of the database; the data stay where they are."""
        db = self.databases.get(database or "")
        if db is None:
            raise KeyError(f"database not found: {database}")
        for key in [k for k in db.measurements if k[1] == name]:
            del db.measurements[key]
        self.refresh()

    def measurements(self, database: str | None, policy: str | None, pattern: str | None = None) -> list[Measurement]:
        """Those of a scope whose names a pattern matches, by name."""
        return self._scope(database, policy, lambda n: pattern is None or bool(re.search(pattern, n)))

    def ping(self) -> bool:
        """Whether a job runs."""
        return self.spark.range(1).count() == 1

    def lookup(self, database: str | None, policy: str | None, name: str) -> Measurement:
        db = self.databases.get(database or "")
        if db is None:
            raise KeyError(f"database not found: {database}")
        policy = policy or self.default_policy(database)
        if (policy, name) not in db.measurements:
            raise KeyError(f"measurement not found: {name}")
        return self._get(database, policy, name)

    def default_policy(self, database: str) -> str:
        """The default policy with a name, else the only one; otherwise an error."""
        ps = [p for p in self.databases.get(database, Database()).policies.values() if p.name]
        if not ps:
            raise LookupError(f"no retention policies found for database {database!r}")
        for p in ps:
            if p.default:
                return p.name
        if len(ps) == 1:
            return ps[0].name
        raise LookupError(f"no default retention policy for database {database!r}")

    def _scope(self, database: str | None, policy: str | None, wanted: Callable[[str], bool] = lambda name: True) -> list[Measurement]:
        found = []
        for name, db in self.databases.items():
            if database and name != database:
                continue
            found += [self._get(name, rp, n) for rp, n in db.measurements if (not policy or rp == policy) and wanted(n)]
        return sorted(found, key=lambda m: m.name.encode())

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def show_databases(self) -> DataFrame:
        return self._frame([(d,) for d in self.databases if d and d != "<nil>"], "name string").orderBy("name")

    def show_retention_policies(self, database: str | None = None) -> DataFrame:
        """Of one database, or of all with their names."""
        rows = [(d, p.name, p.duration, p.shard_group_duration, p.replica_n, p.default) for d, db in self.databases.items() for p in db.policies.values() if p.name and (database is None or d == database)]
        schema = "database string, retention_policy string, duration string, shard_group_duration string, replica_n string, `default` boolean"
        return self._frame(rows, schema).orderBy("database", "retention_policy")

    def show_measurements(self, database: str | None = None, policy: str | None = None) -> DataFrame:
        return self._frame([(n,) for n in self.measurement_names(database, policy)], "name string").orderBy("name")

    def field_keys(self, database: str | None = None, policy: str | None = None, measurement: str | None = None) -> DataFrame:
        rows = [(m.name, f, k) for m in self._scope(database, policy, lambda n: measurement in (None, n)) for f, k in m.fields.items()]
        return self._frame(rows, "measurement string, fieldKey string, fieldType string").orderBy("measurement", "fieldKey")

    def tag_keys(self, database: str | None = None, policy: str | None = None, measurement: str | None = None) -> DataFrame:
        rows = [(m.name, t) for m in self._scope(database, policy, lambda n: measurement in (None, n)) for t in m.tags]
        return self._frame(rows, "measurement string, tagKey string").orderBy("measurement", "tagKey")

    def schema(self, database: str | None = None, policy: str | None = None, measurement: str | None = None) -> DataFrame:
        """measurement, kind, name, type: fields and tags merged over measurements that have either."""
        fields = self.field_keys(database, policy, measurement).select("measurement", F.lit("field").alias("kind"), F.col("fieldKey").alias("name"), F.col("fieldType").alias("type"))
        tags = self.tag_keys(database, policy, measurement).select("measurement", F.lit("tag").alias("kind"), F.col("tagKey").alias("name"), F.lit("").alias("type"))
        return fields.unionByName(tags).orderBy("measurement", "kind", "name")

    def cached(self, key: tuple, make):
        """What make() gave for this key, for up to ttl seconds."""
        now = clock.monotonic()
        if key in self._cache and now <= self._cache[key][0] + self.ttl:
            return self._cache[key][1]
        self._cache[key] = (now, make())
        return self._cache[key][1]

    def refresh(self) -> None:
        self._cache.clear()

    def measurement_names(self, database: str | None, policy: str | None) -> list[str]:
        return self.cached(("measurements", database, policy), lambda: sorted({n for d, db in self.databases.items() if not database or d == database for rp, n in db.measurements if not policy or rp == policy}, key=str.encode))

    def keys(self, database: str | None, policy: str | None, measurement: str | None) -> tuple[list[str], list[str]]:
        """(fields, tags) of a measurement, or of all."""

        def make():
            ms = self._scope(database, policy, lambda n: measurement in (None, "", n))
            return sorted({f for m in ms for f in m.fields}), sorted({t for m in ms for t in m.tags})

        return self.cached(("keys", database, policy, measurement), make)


def _measurement(name: str, df: DataFrame, time: str, tags: list[str], fields: list[str]) -> Measurement:
    cols = [F.col(time).alias("time")]
    cols += [F.col(t).cast("string").alias(t, metadata={"role": "tag"}) for t in tags]
    kinds = {f: FIELD_TYPES.get(df.schema[f].dataType.simpleString(), "string") for f in fields}
    cols += [F.col(f).alias(f, metadata={"role": "field", "ftype": kinds[f]}) for f in fields]
    return Measurement(name, df.select(*cols), list(tags), kinds)


def first_value(df: DataFrame, name: str, alias: str) -> DataFrame:
    """df with one column `alias` in place of all columns of a name, whatever its case: the first of them that isn't null in a row; null if there is none."""
    by_place = df.toDF(*(f"__{i}" for i in range(len(df.columns))))
    same = [F.col(f"__{i}") for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    rest = [F.col(f"__{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() != name.lower()]
    return by_place.select(*rest, (F.coalesce(*same) if same else F.lit(None).cast("string")).alias(alias))


def series_keys(m: Measurement) -> DataFrame:
    """name,tag=value,... of each distinct tag set; tags by name, null and empty ones left out."""
    parts = [F.when(F.col(f"`{t}`") != "", F.concat(escape_key(F.lit(t)), F.lit("="), escape_key(F.col(f"`{t}`")))) for t in sorted(m.tags)]
    return m.df.select(*(f"`{t}`" for t in m.tags)).distinct().select(F.concat_ws(",", escape_measurement(F.lit(m.name)), *parts).alias("key")) if m.tags else m.df.limit(1).select(escape_measurement(F.lit(m.name)).alias("key"))


def tag_values(m: Measurement, key: str) -> DataFrame:
    """key and value of a tag's distinct values."""
    if key not in m.tags:
        return m.df.select(F.lit(key).alias("key"), F.lit("").alias("value")).where("false")
    return m.df.select(F.lit(key).alias("key"), F.col(f"`{key}`").alias("value")).where("value IS NOT NULL").distinct()


def series_cardinality(m: Measurement) -> DataFrame:
    """The number of distinct tag sets."""
    return m.df.agg(F.count_distinct(F.struct(*m.tags)).alias("cardinality")) if m.tags else m.df.limit(1).agg(F.count("*").alias("cardinality"))


def tag_cardinality(m: Measurement, k: int | None = None) -> DataFrame:
    """Distinct values of each tag, most first."""
    counts = m.df.agg(*(F.count_distinct(t).alias(t) for t in m.tags)).unpivot([], m.tags, "tag", "values_count").orderBy(F.desc("values_count"), "tag")
    return counts if k is None else counts.limit(k)


def merged_schema(fields: DataFrame, tags: DataFrame) -> DataFrame:
    """Full outer merge by measurement of (measurement, field, type) and (measurement, tag): arrays of both, sorted."""
    f = fields.groupBy("measurement").agg(F.array_sort(F.collect_list(F.struct("field", "type"))).alias("fields"))
    t = tags.groupBy("measurement").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return f.join(t, "measurement", "full_outer").orderBy("measurement")
