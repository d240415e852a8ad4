"""Tables of an SQLite file as a Spark data source, read in ranges of the row id."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_TYPES = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.table, self.parts, self.names = options["path"], options["table"], int(options.get("partitions", 8)), names

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f"select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from {_quoted(self.table)}").fetchone()
        step = max(1, (high - low + self.parts) // self.parts)
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)] or [_Range(0, -1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high = partition.value
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            yield from con.execute(f"select {', '.join(map(_quoted, self.names))} from {_quoted(self.table)} where rowid between ? and ?", (low, high))


class SqliteSource(DataSource):
    """``spark.read.format("lexisteppe_sqlite")`` with the options path, table and partitions."""

    @classmethod
    def name(cls) -> str:
        return "lexisteppe_sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            columns = con.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{name}` {next((t for k, t in _TYPES.items() if k in (kind or '').upper()), 'string')}" for _, name, kind, *_ in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema.names)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of an SQLite file that every executor can open."""
    from ..runtime import ship_package

    ship_package(spark)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("lexisteppe_sqlite").option("path", path).option("table", table).option("partitions", partitions).load()
