"""Sources, snapshots and functions, each over files that the query writes from the test tables."""

from __future__ import annotations

import atexit
import functools
import json
import os
import shutil
import sqlite3
import tempfile
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.queries.tables import table
from tributary.service import Engine
from tributary.sources import file as fs
from tributary.sources.http import table as http
from tributary.storage import Files, new_path, qualified
from tributary.streaming.windows import windowed_counts


def scratch(spark: SparkSession) -> str:
    """URI of a new folder that all executors share, for what Spark writes or reads."""
    return qualified(spark, new_path(spark, "scratch"))


def own_folder() -> str:
    """A folder of the driver's own, for what only the driver reads."""
    d = tempfile.mkdtemp(prefix="tributary-q-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    return d


def _nation(spark: SparkSession, d: str) -> list:
    return table(spark, d, "nation").orderBy("n_nationkey").collect()


def src_csv(spark: SparkSession, d: str) -> DataFrame:
    p = scratch(spark)
    table(spark, d, "customer").write.csv(f"{p}/c.csv", header=True, sep="\t")
    return fs.read_table(spark, f"{p}/c.csv", {"csv": {"delimiter": "\\t"}})


def src_ndjson_declared(spark: SparkSession, d: str) -> DataFrame:
    p = scratch(spark)
    table(spark, d, "events").select("event_id", F.col("value").alias("n"), F.struct("user_id").alias("o"), "event_type").write.json(f"{p}/e.json")
    schema = [{"name": "event_id", "type": "varchar"}, {"name": "n", "type": "bigint"}, {"name": "o", "type": "json"}, {"name": "event_type", "type": "double"}, {"name": "absent", "type": "int"}]
    return fs.read_table(spark, f"{p}/e.json", {"schema": schema})


def src_json_array(spark: SparkSession, d: str) -> DataFrame:
    p = scratch(spark)
    Files(spark, p).write(f"{p}/n.json", json.dumps([r.asDict() for r in _nation(spark, d)]).encode())
    return fs.read_table(spark, f"{p}/n.json", {} if p.startswith("file:") else {"json": {"format": "array"}}).select("n_nationkey", "n_name")


def src_hive(spark: SparkSession, d: str) -> DataFrame:
    p = scratch(spark)
    table(spark, d, "part").select("p_partkey", "p_type", "p_size").write.partitionBy("p_type").parquet(f"{p}/t")
    return fs.read_table(spark, f"{p}/t", {"format": "parquet", "partition_cols": [{"name": "p_type", "type": "varchar"}]}).filter("p_type = 'PROMO'")


def src_segment(spark: SparkSession, d: str) -> DataFrame:
    """Positional partitions, one for every status that occurs."""
    p, o = scratch(spark), table(spark, d, "orders")
    for r in o.select("o_orderstatus").distinct().collect():
        o.filter(F.col("o_orderstatus") == r[0]).select("o_orderkey").write.parquet(f"{p}/base/{r[0]}/x")
    return fs.read_table(spark, f"{p}/base/*/x", {"format": "parquet", "segments": [{"name": "status", "index": 0}]})


def src_ndjson(spark: SparkSession, d: str) -> DataFrame:
    """NDJSON with inferred types."""
    p = scratch(spark)
    table(spark, d, "events").select("event_id", F.struct("user_id").alias("o"), "event_type").write.json(f"{p}/e.ndjson")
    return fs.read_table(spark, f"{p}/e.ndjson").filter("event_id % 2 = 0").select("event_id", "o.user_id", "event_type")


def src_pushdown(spark: SparkSession, d: str) -> DataFrame:
    """A DuckDB file scanned in place, with filters in its own SQL."""
    import duckdb

    p = own_folder()
    con = duckdb.connect(f"{p}/x.duckdb")
    con.execute(f"CREATE TABLE supplier AS SELECT * FROM read_parquet('{d}/supplier.parquet')")
    con.close()
    e = Engine(spark, {"sources": [{"name": "wh", "kind": "duckdb", "config": {"path": f"{p}/x.duckdb"}}]})
    return e.query("SELECT * FROM wh.supplier WHERE s_nationkey IN (1, 2, 3) AND s_suppkey > 2").df


def src_cached(spark: SparkSession, d: str) -> DataFrame:
    """A cached API table: two rows are added to the API behind it after the first read, and only a refresh shows them."""
    rows = [(("id", r["n_nationkey"]), ("name", r["n_name"]), ("region", r["n_regionkey"])) for r in _nation(spark, d)]
    handler = type("Api", (_Api,), {"rows": [dict(r) for r in rows]})
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = Engine(spark, {"sources": [{"name": "api", "kind": "http", "config": {"base_url": f"http://127.0.0.1:{server.server_port}", "tables": [_ITEMS]}, "cache": {"ttl": "1h"}}]})
    before = e.query("SELECT id, name FROM api.items").df
    handler.rows += [{"id": 900 + k, "name": "late", "region": 0} for k in range(2)]
    again = e.query("SELECT count(*) AS n FROM api.items").df.first()[0]
    assert again == len(rows)
    e.refresh_table("api.items")
    return before.crossJoin(e.query("SELECT count(*) AS n FROM api.items").df)


def src_sqlite(spark: SparkSession, d: str) -> DataFrame:
    p = own_folder()
    con = sqlite3.connect(f"{p}/n.db")
    con.execute("CREATE TABLE nation (id INTEGER, region_id INTEGER, name TEXT)")
    con.executemany("INSERT INTO nation VALUES (?, ?, ?)", [(r["n_nationkey"], r["n_regionkey"], r["n_name"]) for r in _nation(spark, d)])
    con.commit()
    con.close()
    e = Engine(spark, {"sources": [{"name": "crm", "kind": "sqlite", "config": {"path": f"{p}/n.db"}}]})
    return e.query("SELECT region_id, count(*) AS n FROM crm.nation WHERE id > 3 GROUP BY region_id").df


def src_duckdb(spark: SparkSession, d: str) -> DataFrame:
    import duckdb

    p = own_folder()
    con = duckdb.connect(f"{p}/x.duckdb")
    con.execute(f"CREATE TABLE supplier AS SELECT * FROM read_parquet('{d}/supplier.parquet')")
    con.close()
    e = Engine(spark, {"sources": [{"name": "wh", "kind": "duckdb", "config": {"path": f"{p}/x.duckdb"}}]})
    return e.query("SELECT s_nationkey, count(*) AS n FROM wh.supplier s GROUP BY s_nationkey").df


def materialize_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark, {"sources": [{"name": "tpch", "kind": "file", "config": {"path": f"{d}/*.parquet"}}]})
    e.materialize("by_priority", query="SELECT o_orderpriority, count(*) AS n FROM tpch.orders GROUP BY o_orderpriority")
    return e.query("-- tributary: materialize top\nSELECT o_orderpriority, n FROM materialized.by_priority WHERE n > ${param:least}", {"least": "1"}).df


def fn_file_glob(spark: SparkSession, d: str) -> DataFrame:
    p = own_folder()
    for r in _nation(spark, d):
        with open(f"{p}/{r['n_name']}.txt", "w") as f:
            f.write(f"key {r['n_nationkey']}\nregion {r['n_regionkey']}\n")
    e = Engine(spark, {"base": p})
    return e.query("SELECT file_name, size_bytes FROM file.glob('NATION_1*.txt')").df


def fn_file_grep(spark: SparkSession, d: str) -> DataFrame:
    p = own_folder()
    for r in _nation(spark, d):
        with open(f"{p}/{r['n_name']}.txt", "w") as f:
            f.write(f"key {r['n_nationkey']}\nregion {r['n_regionkey']}\n")
    e = Engine(spark, {"base": p})
    return e.query("SELECT line, count(*) AS n FROM file.grep('^region [12]$', '*.txt') GROUP BY line").df


class _Api(BaseHTTPRequestHandler):
    """A small API over given rows: /items?region=&page=, /item/{id}."""

    rows: list[dict] = []

    def do_GET(self):  # noqa: N802
        u = urlsplit(self.path)
        q = {k: v for k, v in parse_qs(u.query).items()}
        if u.path == "/items":
            got = [r for r in self.rows if "region" not in q or str(r["region"]) in q["region"]]
            page = int(q.get("page", ["1"])[0])
            body = {"items": got[(page - 1) * 4 : page * 4]}
        else:
            body = next((r for r in self.rows if str(r["id"]) == u.path.rsplit("/", 1)[-1]), None)
        data = json.dumps(body).encode()
        self.send_response(404 if body is None else 200)
        self.send_header("Content-Type", "application/json")
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@functools.cache
def api(rows: tuple) -> str:
    handler = type("Api", (_Api,), {"rows": [dict(r) for r in rows]})
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_port}"


def _source(spark: SparkSession, d: str) -> dict:
    rows = tuple((("id", r["n_nationkey"]), ("name", r["n_name"]), ("region", r["n_regionkey"])) for r in _nation(spark, d))
    return {"name": "api", "base_url": api(rows)}


_COLS = [{"name": "id", "type": "bigint"}, {"name": "name", "type": "varchar"}, {"name": "region", "type": "int"}]
_ITEMS = {"name": "items", "path": "/items", "params": [{"name": "region", "type": "int"}], "pagination": {"type": "page", "param": "page"}, "response": {"rows_path": "$.items", "schema": _COLS}}
_ITEM = {"name": "item", "path": "/item/{id}", "params": [{"name": "id", "in": "path", "required": True, "type": "bigint"}], "response": {"schema": _COLS, "not_found_empty": True}}


def http_typed(spark: SparkSession, d: str) -> DataFrame:
    return http.read_table(spark, _source(spark, d), _ITEMS).filter("region IN (1, 3) AND id > 5").select("id", "name")


def http_dependent_join(spark: SparkSession, d: str) -> DataFrame:
    """A join that gives an API table its required column, as plain SQL."""
    config = [{"name": "api", "kind": "http", "config": {**_source(spark, d), "tables": [_ITEM]}}, {"name": "t", "kind": "file", "config": {"path": f"{d}/supplier.parquet"}}]
    return Engine(spark, {"sources": config}).query("SELECT s.k, i.name, i.region FROM (SELECT DISTINCT s_nationkey AS k FROM t.supplier) s JOIN api.item i ON i.id = s.k").df


def http_dependent_frames(spark: SparkSession, d: str) -> DataFrame:
    """The same as a function over frames."""
    keys = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    return http.dependent_join(keys, "k", _source(spark, d), _ITEM, "id").select("k", "name", "region")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "1 day").select("start", "event_type", "n")


def stream_live(spark: SparkSession, d: str) -> DataFrame:
    """The same over a stream of files, run until all that is there is read; each batch's state replaces the result."""
    p = scratch(spark)
    table(spark, d, "events").repartition(4).write.parquet(f"{p}/events")
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 2).parquet(f"{p}/events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(stream, "ts", ["event_type"], "1 day", late="30 days", value="value")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{p}/out")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{p}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{p}/out")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (src_csv, src_ndjson_declared, src_json_array, src_hive, src_segment, src_sqlite, src_duckdb, materialize_roundtrip, fn_file_glob, fn_file_grep, http_typed, http_dependent_join, http_dependent_frames, src_ndjson, src_pushdown, src_cached, stream_windows, stream_live)}
ORACLE = {
    "src_csv": "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "src_ndjson_declared": "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(trunc(value) AS BIGINT) AS n, '{\"user_id\":' || user_id || '}' AS o, CAST(NULL AS DOUBLE) AS event_type, CAST(NULL AS INTEGER) AS absent FROM events",
    "src_json_array": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation",
    "src_hive": "SELECT p_partkey, p_size, p_type FROM part WHERE p_type = 'PROMO'",
    "src_segment": "SELECT o_orderkey, o_orderstatus AS status FROM orders",
    "src_sqlite": "SELECT CAST(n_regionkey AS BIGINT) AS region_id, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1",
    "src_duckdb": "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1",
    "materialize_roundtrip": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
    "fn_file_glob": "SELECT n_name || '.txt' AS file_name, CAST(length('key ' || n_nationkey) + 1 + length('region ' || n_regionkey) + 1 AS BIGINT) AS size_bytes FROM nation WHERE n_name LIKE 'NATION\\_1%' ESCAPE '\\'",
    "fn_file_grep": "SELECT 'region ' || n_regionkey AS line, count(*) AS n FROM nation WHERE n_regionkey IN (1, 2) GROUP BY 1",
    "http_typed": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey > 5",
    "http_dependent_join": "SELECT DISTINCT s_nationkey AS k, n_name AS name, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "http_dependent_frames": "SELECT DISTINCT s_nationkey AS k, n_name AS name, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "src_ndjson": "SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id, event_type FROM events WHERE event_id % 2 = 0",
    "src_pushdown": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey IN (1, 2, 3) AND s_suppkey > 2",
    "src_cached": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, (SELECT count(*) FROM nation) + 2 AS n FROM nation",
    "stream_live": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_windows": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
