"""What a source of query results and a writer of lines must offer, and both over this engine's own catalog."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from .session import Result, Session
from .sources import lineproto
from .sources.catalog import Catalog


class Adapter(Protocol):
    def ping(self) -> bool: ...
    def query(self, text: str) -> Result: ...
    def databases(self) -> DataFrame: ...
    def retention_policies(self, database: str) -> DataFrame: ...
    def measurements(self, database: str, policy: str | None = None) -> DataFrame: ...
    def schema(self, database: str, policy: str | None = None, measurement: str | None = None) -> DataFrame: ...


class LineWriter(Protocol):
    def write(self, lines: DataFrame, database: str, policy: str, unit: str) -> None: ...


class CatalogAdapter:
    """An Adapter over a catalog."""

    def __init__(self, session: Session):
        self.session, self.catalog = session, session.catalog

    def ping(self) -> bool:
        return self.catalog.ping()

    def query(self, text: str) -> Result:
        return self.session.execute(text)

    def databases(self) -> DataFrame:
        return self.catalog.show_databases()

    def retention_policies(self, database: str) -> DataFrame:
        return self.catalog.show_retention_policies(database)

    def measurements(self, database: str, policy: str | None = None) -> DataFrame:
        return self.catalog.show_measurements(database, policy)

    def schema(self, database: str, policy: str | None = None, measurement: str | None = None) -> DataFrame:
        return self.catalog.schema(database, policy, measurement)


class ParquetLines:
    """A LineWriter to Parquet under a folder."""

    def __init__(self, root: str, catalog: Catalog | None = None):
        self.root, self.catalog = root, catalog

    def write(self, lines: DataFrame, database: str, policy: str = "autogen", unit: str = "ns") -> None:
        lineproto.write(lines, self.root, database, policy, unit)
