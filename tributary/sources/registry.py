"""Loaders by source kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.errors import EngineError
from tributary.sources import database, file, mcp
from tributary.sources.http import table as http

Loader = Callable[[SparkSession, dict], dict[str, DataFrame]]
LOADERS: dict[str, Loader] = {
    "file": file.tables, "http": http.tables, "mcp": mcp.tables, "sqlite": database.sqlite_tables, "duckdb": database.duckdb_tables, "ducklake": database.duckdb_tables,
    **{k: database.jdbc_tables(k) for k in ("postgres", "mysql", "snowflake")}, **{k: database.lake_tables(k) for k in ("iceberg", "delta")},
}


def load(spark: SparkSession, kind: str, config: dict) -> dict[str, DataFrame]:
    if kind not in LOADERS:
        raise EngineError("UNKNOWN_KIND", f"no source kind {kind!r}; there are {', '.join(sorted(LOADERS))}")
    return LOADERS[kind](spark, config)
