"""SQLite files as a Spark data source: ``spark.read.format("sqlite_files").option("path", ...).option("table", ...)``.

``path`` is a file, or a folder whose ``.db`` files hold parts of the table; executors must see it. Each file's table is read in ranges of
its row numbers, a task each, of about ``rows`` rows (100,000 unless given), so a large file is read by many tasks. The schema's columns alone,
and filters that SQLite can judge as Spark does (comparisons with numbers and texts, IN, null tests, prefixes), are part of each
range's SELECT; Spark keeps the other filters. Files are opened for reading only.

Defined cases: a table that a file lacks is an error, an empty one gives no rows; values that don't fit the column's type are an
error; views and tables without row numbers are read in one range.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_COMPARES = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: fixed values: SQLite's affinities by parts of a declared type, and their Spark types
_KINDS = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)


def _files(path: str) -> list[str]:
    here = Path(path.removeprefix("file://").removeprefix("file:"))
    return sorted(map(str, here.glob("*.db"))) if here.is_dir() else [str(here)]


@dataclass
class Range(InputPartition):
    """Rows of one file from ``low`` up to below ``high``, or all of a view."""

    path: str
    low: int | None
    high: int | None


class SqliteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def schema(self) -> str:
        """Column types by SQLite's rules of affinity, from the first file."""
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no .db files in {self.options['path']}")
        with _open(files[0]) as con:
            columns = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {files[0]}")
        kind = lambda declared: next((k for part, k in _KINDS if part in declared.upper()), "double" if declared else "binary")
        return ", ".join(f"`{name.replace('`', '``')}` {kind(declared)}" for _, name, declared, *_ in columns)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.table, self.path = schema, options["table"], options["path"]
        self.rows, self.where, self.values = int(options.get("rows", 100_000)), [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        """Whether a filter goes into the SELECT."""
        plain = lambda v: isinstance(v, str) or isinstance(v, int) and not isinstance(v, bool) and abs(v) < 2**63 or isinstance(v, float) and v == v
        path = getattr(f, "attribute", ())  # a negated filter has none of its own
        if len(path) != 1:
            return False
        column = _quoted(path[0])
        if type(f) in _COMPARES and plain(f.value):
            self.where.append(f"{column} {_COMPARES[type(f)]} ? COLLATE BINARY")
            self.values.append(f.value)
        elif isinstance(f, In) and f.value and len(f.value) <= 500 and all(map(plain, f.value)):
            self.where.append(f"{column} COLLATE BINARY IN ({', '.join('?' * len(f.value))})")
            self.values += f.value
        elif isinstance(f, (IsNull, IsNotNull)):
            self.where.append(f"{column} IS {'' if isinstance(f, IsNull) else 'NOT '}NULL")
        elif isinstance(f, StringStartsWith):
            self.where.append(f"substr({column}, 1, ?) = ?")
            self.values += [len(f.value), f.value]
        else:
            return False
        return True

    def partitions(self) -> list[Range]:
        out = []
        for path in _files(self.path):
            with _open(path) as con:
                if con.execute("SELECT 1 FROM sqlite_master WHERE type = 'view' AND lower(name) = lower(?)", (self.table,)).fetchone():
                    out.append(Range(path, None, None))
                    continue
                try:
                    low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    out.append(Range(path, None, None))
                    continue
            if low is not None:
                out += [Range(path, at, min(at + self.rows, high + 1)) for at in range(low, high + 1, self.rows)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has rows
            return
        kinds = to_arrow_schema(self.schema)
        names = [_quoted(f.name) for f in self.schema]
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append("rowid >= ? AND rowid < ?")
            values += [partition.low, partition.high]
        with _open(partition.path) as con:
            found = con.execute(f"SELECT {', '.join(names)} FROM {_quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values)
            while rows := found.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds.types)], schema=kinds)


def register(spark: SparkSession) -> None:
    """Make ``sqlite_files`` known to the session, with filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteFiles)


def sqlite_table(spark: SparkSession, path: str, table: str, ddl: str | None = None, rows: int = 100_000) -> DataFrame:
    """A table of SQLite files, with the columns and types of ``ddl`` if given: only those are read."""
    register(spark)
    reader = spark.read.format("sqlite_files").option("path", path).option("table", table).option("rows", rows)
    return (reader.schema(ddl) if ddl else reader).load()
