"""Databases and lakehouse tables, read only."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tributary.errors import EngineError
from tributary.sources import embedded
from tributary.storage import new_path

#: Rows per file that a driver-side reader hands over.
BATCH = 200_000


def heuristic_type(name: str) -> T.DataType:
    """SQLite columns by name: id, *_id, *_count and is_* are integers, all else text."""
    n = name.lower()
    return T.LongType() if n == "id" or n.endswith(("_id", "_count")) or n.startswith("is_") else T.StringType()


def _hand_over(spark: SparkSession, name: str, schema: T.StructType, batches: Iterator[pa.Table]) -> DataFrame:
    """Tables that only the driver can read, written in batches to the shared folder and scanned from there, so that nothing is held whole."""
    from pyspark.sql.pandas.types import to_arrow_schema

    path, arrow = new_path(spark, name), to_arrow_schema(schema)
    wrote = False
    for b in batches:
        spark.createDataFrame(b.cast(arrow)).write.mode("append").parquet(path)
        wrote = True
    return spark.read.schema(schema).parquet(path) if wrote else spark.createDataFrame([], schema)


def _in_place(spark: SparkSession, config: dict) -> bool:
    """Whether executors can open the file themselves: they are this machine, or ``shared`` says that the path is mounted on all of them."""
    return bool(config.get("shared", spark.sparkContext.master.startswith("local")))


def sqlite_tables(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """All user tables, or the declared ``tables`` [{name, query}]. A file that executors can open is scanned there with filters pushed down, any other one is
    handed over by the driver."""
    path = config["path"]
    if not os.path.exists(path):
        raise EngineError("SOURCE_REGISTRATION", f"no database file {path!r}")
    con = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    try:
        wanted = {t["name"]: t.get("query") or f'SELECT * FROM "{t["name"]}"' for t in config.get("tables", [])}
        own = {t["name"] for t in config.get("tables", []) if t.get("query")}
        if not wanted:
            names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
            wanted = {n: 'SELECT * FROM "' + n.replace('"', '""') + '"' for n in names}
        out = {}
        for n, q in wanted.items():
            cur = con.execute(q)
            cols = [c[0] for c in cur.description]
            schema = T.StructType([T.StructField(c, heuristic_type(c)) for c in cols])
            if _in_place(spark, config):
                out[n] = embedded.read_table(spark, "sqlite", os.path.abspath(path), q, None if n in own else '"' + n.replace('"', '""') + '"', schema)
                continue

            def batches(cur=cur, cols=cols, schema=schema):
                while rows := cur.fetchmany(BATCH):
                    data = list(zip(*rows))
                    yield pa.table({c: pa.array([embedded.cell(v, f.dataType) for v in data[k]], pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for k, (c, f) in enumerate(zip(cols, schema))})

            out[n] = _hand_over(spark, n, schema, batches())
        return out
    finally:
        con.close()


def duckdb_tables(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Tables of a DuckDB file, or of a DuckLake catalog when ``attach`` names one; each is handed over in batches as Parquet in the shared folder and read from there.
    A file that executors can open is scanned there instead, with filters pushed down."""
    import duckdb

    con = duckdb.connect() if config.get("attach") else duckdb.connect(config["path"], read_only=True)
    try:
        if config.get("attach"):
            try:
                con.execute(f"ATTACH '{config['attach']}' AS src (READ_ONLY)")
                con.execute("USE src")
            except Exception as e:
                raise EngineError("UNSUPPORTED", f"this DuckDB can't attach {config['attach']!r}: {e}") from e
        wanted = {t["name"]: t.get("query") or f'SELECT * FROM "{t["name"]}"' for t in config.get("tables", [])}
        if not wanted:
            wanted = {n: f'SELECT * FROM "{s}"."{n}"' for s, n in con.execute("SELECT table_schema, table_name FROM information_schema.tables WHERE table_catalog = current_database() AND table_schema NOT IN ('information_schema', 'pg_catalog') ORDER BY 1, 2").fetchall()}
        out = {}
        for n, q in wanted.items():
            if not config.get("attach") and _in_place(spark, config):
                schema = spark.createDataFrame(con.execute(f"SELECT * FROM ({q}) LIMIT 0").to_arrow_reader(1).schema.empty_table()).schema
                plain = not any(t.get("query") for t in config.get("tables", []) if t["name"] == n)
                out[n] = embedded.read_table(spark, "duckdb", os.path.abspath(config["path"]), q, q.removeprefix("SELECT * FROM ") if plain else None, schema)
                continue
            path, cur = new_path(spark, n), con.execute(q)
            reader = cur.fetch_record_batch(BATCH) if hasattr(cur, "fetch_record_batch") else cur.to_arrow_reader(BATCH)
            schema = spark.createDataFrame(reader.schema.empty_table()).schema
            wrote = False
            for b in reader:
                spark.createDataFrame(pa.Table.from_batches([b])).write.mode("append").parquet(path)
                wrote = True
            out[n] = spark.read.schema(schema).parquet(path) if wrote else spark.createDataFrame([], schema)
        return out
    finally:
        con.close()


_JDBC = {"postgres": ("jdbc:postgresql://{host}:{port}/{database}", 5432), "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306), "snowflake": ("jdbc:snowflake://{host}/?db={database}&warehouse={warehouse}", 443)}


def jdbc_options(kind: str, config: dict) -> dict[str, str]:
    """Reader options; a declared partition column with its bounds splits a large table over tasks."""
    url, port = _JDBC[kind]
    o = {"url": config.get("url") or url.format(**{"port": port, "warehouse": "", **config}), "fetchsize": str(config.get("fetchsize", 10_000)), "pushDownPredicate": "true", "pushDownLimit": "true", "pushDownAggregate": "true"}
    o |= {k: str(config[k]) for k in ("user", "password") if k in config}
    if "partition" in config:
        p = config["partition"]
        o |= {"partitionColumn": p["column"], "lowerBound": str(p["lower"]), "upperBound": str(p["upper"]), "numPartitions": str(p.get("count", 64))}
    return o


# Schemas that hold no tables of the user.
_OWN_SCHEMAS = ("information_schema", "pg_catalog", "mysql", "performance_schema", "sys", "INFORMATION_SCHEMA")


def discovery_query(kind: str, config: dict) -> str:
    """What lists a database's tables and views: those of ``schema`` where one is given, else all of the user's."""
    only = f"table_schema = '{config['schema']}'" if config.get("schema") else "table_schema NOT IN (" + ", ".join(f"'{x}'" for x in _OWN_SCHEMAS) + ")"
    if kind == "mysql" and config.get("database") and not config.get("schema"):
        only = f"table_schema = '{config['database']}'"
    return f"SELECT table_schema AS s, table_name AS n FROM information_schema.tables WHERE {only} ORDER BY 1, 2"


def discovered(spark: SparkSession, kind: str, config: dict) -> list[dict]:
    """Declarations of all tables; one whose name stands in several schemas is called schema__table."""
    try:
        found = [(r[0], r[1]) for r in spark.read.format("jdbc").options(**jdbc_options(kind, config)).option("query", discovery_query(kind, config)).load().collect()]
    except Exception as e:
        raise EngineError("SOURCE_UNREACHABLE", f"{kind}: {str(e)[:300]}") from e
    names = [n for _, n in found]
    return [{"name": n if names.count(n) == 1 else f"{s}__{n}", "table": f"{s}.{n}"} for s, n in found]


def jdbc_tables(kind: str):
    def load(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
        out = {}
        for t in config.get("tables") or discovered(spark, kind, config):
            r = spark.read.format("jdbc").options(**jdbc_options(kind, {**config, **t}))
            try:
                out[t["name"]] = (r.option("query", t["query"]) if t.get("query") else r.option("dbtable", t.get("table", t["name"]))).load()
            except Exception as e:
                raise EngineError("SOURCE_UNREACHABLE", f"{kind} table {t['name']!r}: {e}") from e
        return out

    return load


def lake_tables(kind: str):
    def load(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
        if not config.get("tables"):
            raise EngineError("CONFIG_SOURCE", f"a {kind} source needs its tables listed")
        try:
            return {t["name"]: spark.read.format(kind).load(t["path"]) for t in config["tables"]}
        except Exception as e:
            raise EngineError("UNSUPPORTED", f"no {kind} connector in this session, or no such table: {str(e)[:300]}") from e

    return load
