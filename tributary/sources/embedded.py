"""SQLite and DuckDB files as Spark data sources: filters go into the file's own SQL, ranges of row numbers are the partitions, nothing passes the driver."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Rows of a partition, about, and of a batch.
ROWS, BATCH = 500_000, 20_000


def connect(kind: str, path: str):
    if kind == "sqlite":
        return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    import duckdb

    return duckdb.connect(path, read_only=True)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


class Span(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))


def cell(v, kind: T.DataType):
    """A SQLite value as its declared type; what doesn't fit is null."""
    if v is None:
        return None
    if isinstance(kind, T.LongType):
        try:
            return int(v)
        except (TypeError, ValueError):
            return None
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


class EmbeddedReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.kind, self.path, self.query, self.table = options["db"], options["file"], options["query"], options.get("table")
        self.schema, self.where, self.values, self.rows = schema, [], [], int(options.get("rows", ROWS))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        names = {f.name: f.dataType for f in self.schema}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            kind = names.get(name)
            # a SQLite cell may be of another type than its column, so only whole numbers are compared there
            plain = isinstance(kind, (T.LongType, T.IntegerType)) or self.kind == "duckdb" and isinstance(kind, (T.StringType, T.ShortType, T.ByteType, T.BooleanType))
            if name and type(f) in _SIGNS and plain and isinstance(f.value, (int, str)):
                self.where.append(f"{_name(name)} {_SIGNS[type(f)]} ?")
                self.values.append(f.value)
            elif name and isinstance(f, In) and plain and f.value and all(isinstance(v, (int, str)) for v in f.value):
                self.where.append(f"{_name(name)} IN ({', '.join('?' * len(f.value))})")
                self.values += list(f.value)
            elif name and isinstance(f, (IsNull, IsNotNull)) and (self.kind == "duckdb" or isinstance(f, IsNotNull)):
                self.where.append(f"{_name(name)} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            yield f  # checked again on the rows: a cell that doesn't fit its column is null

    def partitions(self) -> list[InputPartition]:
        if not self.table:
            return [Span(None, None)]
        con = connect(self.kind, self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        except Exception:  # a table without row numbers; those of a view are null
            return [Span(None, None)]
        finally:
            con.close()
        return [Span(None, None)] if low is None else [Span(k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        low, high = partition.value
        con, arrow = connect(self.kind, self.path), to_arrow_schema(self.schema)
        where, values = list(self.where), list(self.values)
        source = f"({self.query})"
        if low is not None:
            source = self.table
            where.append("rowid BETWEEN ? AND ?")
            values += [low, high]
        columns = ", ".join(_name(f.name) for f in self.schema) or "1"
        cur = con.execute(f"SELECT {columns} FROM {source} AS q" + (" WHERE " + " AND ".join(where) if where else ""), values)
        try:
            while rows := cur.fetchmany(BATCH):
                data = list(zip(*rows))
                cols = [pa.array([cell(v, f.dataType) for v in data[k]] if self.kind == "sqlite" else data[k], arrow.field(k).type) for k, f in enumerate(self.schema)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        finally:
            con.close()


class EmbeddedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tributary_embedded"

    def schema(self):
        return T.StructType.fromJson(json.loads(self.options["columns"]))

    def reader(self, schema) -> EmbeddedReader:
        return EmbeddedReader(dict(self.options), schema)


def read_table(spark: SparkSession, kind: str, path: str, query: str, table: str | None, schema: T.StructType) -> DataFrame:
    """A table or query of the file at ``path``, which every executor must be able to open."""
    spark.dataSource.register(EmbeddedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("tributary_embedded").option("db", kind).option("file", path).option("query", query).option("columns", schema.json()).option("rows", ROWS)
    return (r.option("table", table) if table else r).load()
