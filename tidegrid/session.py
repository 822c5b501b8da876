"""A session: the current database and policy, statements and meta commands, and their results."""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .functions.text import format_latency, one_line
from .operators.series import unpivot
from .plans.compiler import Compiler
from .plans.lexer import QueryError, kind
from .sources.catalog import Catalog

HELP = [
    (":use db[.rp]", "choose a database and a retention policy"),
    (":db db", "choose a database and its default policy"),
    (":rp rp", "choose a retention policy"),
    (":dbs", "list databases"),
    (":rps [db]", "list retention policies"),
    (":measurements", "list measurements"),
    (":schema [m]", "fields and tags"),
    (":fields [m]", "fields and their types"),
    (":tags [m]", "tags"),
    (":refresh schema", "forget cached names"),
    (":status", "the session"),
    (":help", "this list"),
]


@dataclass
class Result:
    """A lazy result; series is there if rows have a time and numbers."""

    df: DataFrame
    series: DataFrame | None = None
    metadata: dict[str, object] = field(default_factory=dict)

    def kind(self) -> str:
        if self.metadata.get("schema"):
            return "schema"
        if self.series is not None and not self.series.isEmpty():
            return "series"
        return "empty" if self.df.isEmpty() else "table"


class Session:
    def __init__(self, spark: SparkSession, catalog: Catalog, database: str = "", policy: str = "", precision: str = "rfc3339", now: Callable[[], dt.datetime] | None = None):
        self.spark, self.catalog, self.now = spark, catalog, now
        self.database, self.policy, self.precision, self.dialect = database, policy, precision, "influxql"
        self.latency, self.error = 0.0, ""
        self._lock = threading.RLock()

    def snapshot(self) -> dict[str, object]:
        with self._lock:
            return {"database": self.database, "rp": self.policy, "precision": self.precision, "dialect": self.dialect, "latency": format_latency(self.latency), "error": one_line(self.error)}

    def prompt(self) -> str:
        return f"{self.database or '-'}{'.' + self.policy if self.policy else ''}> "

    def execute(self, text: str) -> Result:
        """A meta command or a statement; latency and the last error are kept."""
        began = time.monotonic()
        try:
            out = self._meta(text.strip()) if text.strip().startswith(":") else self._query(text)
            self._note(time.monotonic() - began, "")
            return out
        except Exception as e:
            self._note(time.monotonic() - began, str(e))
            raise

    def _note(self, latency: float, error: str) -> None:
        with self._lock:
            self.latency, self.error = latency, error

    def _query(self, text: str) -> Result:
        df = Compiler(self.spark, self.catalog, self.database, self.policy, self.now).run(text)
        numeric = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float", "bigint", "int") and f.name != "statement"]
        tags = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        series = unpivot(df, "", tags, numeric) if "time" in df.columns and numeric else None
        return Result(df, series, {"kind": kind(text), "statement": one_line(text)})

    def _rows(self, rows: list[tuple], schema: str, **metadata) -> Result:
        return Result(self.spark.createDataFrame(rows, schema), None, metadata)

    def _meta(self, text: str) -> Result:
        command, _, rest = text.partition(" ")
        command, rest = command.lower(), rest.strip()
        scope = (self.database or None, self.policy or None)
        if command in (":use", ":db"):
            database, _, policy = rest.rpartition(".") if command == ":use" and "." in rest else (rest, "", "")
            if not database or (command == ":use" and rest.endswith(".")):
                raise QueryError(f"usage: {command} {'db[.rp]' if command == ':use' else 'db'}")
            policy = policy or self.catalog.default_policy(database)
            with self._lock:
                self.database, self.policy = database, policy
            return self._context()
        if command == ":rp":
            if not rest:
                raise QueryError("usage: :rp rp")
            with self._lock:
                self.policy = rest
            return self._context()
        if command == ":dbs":
            return Result(self.catalog.show_databases())
        if command == ":rps":
            return Result(self.catalog.show_retention_policies(rest or self.database or None))
        if command in (":measurements", ":msts"):
            return Result(self.catalog.show_measurements(*scope))
        if command == ":schema":
            if not rest:
                raise QueryError("usage: :schema measurement")
            return Result(self.catalog.schema(*scope, rest), None, {"schema": True})
        if command == ":fields":
            keys = self.catalog.field_keys(*scope, rest or None)
            return Result(keys.withColumnsRenamed({"fieldKey": "field", "fieldType": "type"}))
        if command == ":tags":
            return Result(self.catalog.tag_keys(*scope, rest or None).withColumnRenamed("tagKey", "tag"))
        if command == ":refresh" and rest == "schema":
            self.catalog.refresh()
            return self._rows([("schema cache cleared",)], "status string")
        if command == ":status":
            return self._rows([(k, str(v or "-")) for k, v in self.snapshot().items()], "key string, value string")
        if command == ":help":
            return self._rows(HELP, "command string, description string")
        raise QueryError(f"unknown meta command: {text}")

    def _context(self) -> Result:
        return self._rows([(self.database, self.policy)], "database string, retention_policy string")
