import json
import os
import threading
import time
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from tributary import config as cfg
from tributary import store as st
from tributary.errors import EngineError
from tributary.functions import json as J
from tributary.plans import sqltext
from tributary.semantic.compiler import qualify
from tributary.semantic.model import Catalog, Filter, Query, SemanticError
from tributary.service import Engine, encode, format_rows
from tributary.sources import file as fs
from tributary.sources import mcp
from tributary.sources.http import extract, openapi, request
from tributary.sources.http import guard
from tributary.sources.http import table as http
from tributary.sources.types import json_cell
from tributary.streaming.refresh import Cron, Refresher


def code(call, *args, **kw):
    with pytest.raises((EngineError, SemanticError, sqltext.SqlError)) as e:
        call(*args, **kw)
    return e.value.code


@pytest.fixture
def shop(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)

    write("orders.csv", "id,status,total_amount,ordered_at,customer_id\n1,paid,100,2026-01-15,10\n2,paid,200,2026-02-20,10\n3,paid,400,2026-04-05,20\n")
    write("customers.csv", "id,region\n10,US\n20,EU\n")
    write("order_items.csv", "order_id,sku,quantity\n1,A,2\n1,B,1\n2,A,4\n2,C,1\n2,B,2\n3,A,5\n")
    config = {
        "sources": [{"name": "shop", "kind": "file", "description": "test shop", "config": {"path": f"{tmp_path}/*.csv"}}],
        "base": str(tmp_path),
        "semantic": {
            "models": [
                {"name": "orders", "source": "shop.orders", "dimensions": [{"name": "status"}, {"name": "at", "expr": "ordered_at", "type": "time", "grains": ["day", "month"]}],
                 "measures": [{"name": "revenue", "agg": "sum", "expr": "total_amount"}, {"name": "n", "agg": "count"}],
                 "relationships": [{"name": "items", "kind": "one_to_many", "target": "order_items", "on": "this.id = order_items.order_id"}, {"name": "customer", "kind": "many_to_one", "target": "customers", "on": "this.customer_id = customers.id"}],
                 "pre_aggregations": [{"name": "by_status", "dimensions": ["status"], "measures": ["revenue"]}], "safety": {"max_rows": 1000}},
                {"name": "order_items", "source": "shop.order_items", "dimensions": [{"name": "sku"}], "measures": [{"name": "qty", "agg": "sum", "expr": "quantity"}]},
                {"name": "customers", "source": "shop.customers", "dimensions": [{"name": "region"}], "measures": []},
                {"name": "safe", "source": "shop.orders", "dimensions": [{"name": "status"}], "measures": [{"name": "revenue", "agg": "sum", "expr": "total_amount"}],
                 "safety": {"required_predicates": ["status = ${param:s}"], "require_filters_on": ["status"]}},
            ],
            "metrics": [
                {"name": "running", "kind": {"cumulative": {"measure": "orders.revenue"}}}, {"name": "delta", "kind": {"offset": {"measure": "orders.revenue", "output": "delta"}}},
                {"name": "growth", "kind": {"offset": {"measure": "orders.revenue", "output": "growth"}}}, {"name": "share", "kind": {"share": {"measure": "orders.revenue"}}},
            ],
        },
    }
    return Engine(spark, config, root=str(tmp_path / "store"))


def rows(h):
    return [tuple(r) for r in h.df.collect()]


def test_sql_over_sources(shop):
    assert rows(shop.query("SELECT c.region, sum(o.total_amount) AS t FROM shop.orders o JOIN shop.customers AS c ON o.customer_id = c.id GROUP BY c.region ORDER BY t")) == [("US", 300), ("EU", 400)]
    assert rows(shop.query("SELECT orders.id FROM shop.orders WHERE shop.orders.status = '${param:s}' ORDER BY id", {"s": "paid"}, limit=2)) == [(1,), (2,)]
    assert code(shop.query, "SELECT ${param:x}") == "UNBOUND_PARAM"
    assert rows(shop.query("SELECT j ->> 'a' AS a, j -> 'b' AS b, j ? 'c' AS c FROM VALUES ('{\"a\":\"x\",\"b\":[1,2]}') AS v(j)")) == [("x", "[1,2]", False)]
    assert shop.bounded("SELECT * FROM shop.order_items", 4)[1] is True
    assert [h[1] for h in shop.activity][:2] == ["sql", "sql"] and "paid" not in shop.activity[0][2]
    assert rows(shop.query("SELECT count(*) FROM system.activity"))[0][0] > 3
    assert ("shop", "orders") in rows(shop.query("SELECT table_schema, table_name FROM information_schema.tables"))
    assert "Relation" in shop.explain("SELECT * FROM shop.orders") or shop.explain("SELECT * FROM shop.orders")


def test_catalog(shop):
    assert shop.list_tables() == ["shop.customers", "shop.order_items", "shop.orders"]
    assert shop.search_tables("order")[0]["score"] == 10 and shop.search_tables("test")[0]["score"] == 1 and shop.search_tables("nope") == []
    assert {c["column"] for c in shop.list_columns(name="id")} == {"id", "order_id", "customer_id"}
    assert shop.describe_table("shop.customers")["columns"][0] == {"name": "id", "type": "int"}
    assert "file.glob(pattern)" in shop.list_functions() and shop.health()["ok"]
    assert code(shop.table, "shop.none") == "UNKNOWN_TABLE" and code(shop.remove_source, "x") == "UNKNOWN_SOURCE"
    assert shop.test_source({"name": "x", "kind": "nope"})["ok"] is False
    d = shop.reload_config({**shop.config, "sources": []})
    assert d["removed"] == ["shop"] and shop.list_tables() == []


def test_golden_metrics(shop):
    q = lambda *m, **k: rows(shop.semantic_query(Query(list(m), ["orders.at.month"], order_by=[("orders.at.month", "asc")], **k)))
    assert [r[1] for r in q("running")] == [100, 300, 300, 700]
    assert [r[1] for r in q("delta")] == [None, 100, -200, 400]
    g = [r[1] for r in q("growth")]
    assert g[1] == 1.0 and g[3] is None
    s = [r[1] for r in q("share")]
    assert abs(sum(s) - 1) < 1e-12 and len(s) == 3 and abs(s[0] - 100 / 700) < 1e-12


def test_semantic_safety(shop):
    q = lambda *a, **k: shop.semantic_query(Query(*a, **k))
    assert code(q, ["orders.revenue"], ["order_items.sku"]) == "FAN_OUT"
    assert code(q, ["safe.revenue"]) == "SAFETY_REQUIRED_FILTER"
    f = [Filter("safe.status", "equals", ("paid",))]
    assert code(q, ["safe.revenue"], filters=f) == "SAFETY_UNBOUND_PARAM"
    assert rows(q(["safe.revenue"], filters=f, params={"s": "paid"})) == [(700,)]
    assert rows(q(["safe.revenue"], filters=f, params={"s": "x' OR '1'='1"})) == [(None,)]
    assert code(q) == "EMPTY_QUERY" and code(q, ["orders.x"]) == "UNKNOWN_MEMBER" and code(q, ["x"]) == "UNKNOWN_METRIC" and code(q, ["y.x"]) == "UNKNOWN_MODEL"
    assert code(q, ["running"], ["orders.status"]) == "METRIC_NEEDS_TIME" and code(q, ["orders.n"], ["orders.at.year"]) == "INVALID_GRAIN" and code(q, ["orders.n"], segments=["orders.z"]) == "UNKNOWN_SEGMENT"
    assert code(q, ["safe.revenue"], ["customers.region"], filters=f, params={"s": "a"}) == "DISCONNECTED"
    assert sorted(rows(q(["orders.revenue", "order_items.qty"]))) == [(700, 15)]
    with pytest.raises(SemanticError):
        Catalog.from_dict({"metrics": [{"name": "a", "kind": {"derived": {"expr": "{b}"}}}, {"name": "b", "kind": {"derived": {"expr": "{a}"}}}]})


def test_rollup_is_stored_and_read(shop):
    q = Query(["orders.revenue"], ["orders.status"])
    assert rows(shop.semantic_query(q)) == [("paid", 700)]
    assert "orders__by_status" in shop.store.entries()
    c = shop.compiler()
    assert c.matching_rollup(Query(["orders.n"], ["orders.status"]), []) is None
    assert rows(shop.query("SELECT count(*) FROM semantic.orders__by_status")) == [(1,)]


def test_qualify():
    assert qualify("sum(a) + b.c - 'a' || A", "t", ["a", "c"]) == "sum(`t`.`a`) + b.c - 'a' || `t`.`a`"


def test_store(spark, tmp_path):
    s = st.Store(spark, str(tmp_path), "ns")
    df = spark.range(3)
    s.put("a.b", df, True)
    assert s.get("a.b").count() == 3 and s.fresh("a.b") and st.namespaces(str(tmp_path)) == ["ns"]
    calls = []
    make = lambda: calls.append(1) or spark.range(5)
    assert s.cached("c", make, "1h").count() == 5 and s.cached("c", make, "1h").count() == 5 and len(calls) == 1
    assert s.cached("d", make, 0).count() == 5 and not s.fresh("d") and s.vacuum() and "d" not in s.entries()
    assert s.invalidate() == ["c"] and "a.b" in s.entries()
    e = s.entries()["a.b"]
    os.remove(os.path.join(s.path, e["path"], "_SUCCESS"))
    assert code(s.get, "a.b") == "UNKNOWN_MATERIALIZED" and "a.b" not in s.entries()
    assert code(st.check_name, "../x") == "INVALID_NAME" and code(s.drop, "zz") == "UNKNOWN_MATERIALIZED"
    assert st.seconds("1h30m") == 5400 and code(st.seconds, "soon") == "CONFIG_DURATION"
    open(s._manifest, "w").write("{")
    assert s.entries() == {}


def test_attached_catalog(spark, tmp_path):
    import duckdb

    from tributary.sources.database import duckdb_tables

    con = duckdb.connect(f"{tmp_path}/a.duckdb")
    con.execute("CREATE TABLE t AS SELECT 1 AS x")
    con.close()
    got = duckdb_tables(spark, {"attach": f"{tmp_path}/a.duckdb"})
    assert sorted(got) == ["t"] and [r.x for r in got["t"].collect()] == [1]


def test_snapshots_go_to_the_shared_folder(spark, tmp_path, monkeypatch):
    from tributary import storage
    from tributary.queries import sources

    e = Engine(spark)
    assert e.root.startswith(storage.qualified(spark, storage.shared_dir(spark))) and sources.scratch(spark).startswith(storage.qualified(spark, storage.shared_dir(spark)))
    e.materialize("t", rows=b'[{"a": 1}, {"a": 2}]', fmt="json")
    assert e.store.uri.startswith(storage.qualified(spark, storage.shared_dir(spark)).replace("file:/", "file:///", 1).replace("file://///", "file:///")) and e.table("materialized.t").count() == 2

    class Cluster:
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    assert code(st.Store, Cluster, str(tmp_path)) == "STORE_NOT_SHARED"
    st.Store(Cluster, f"file://{tmp_path}/mounted")


def test_store_through_hadoop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "local", lambda _: None)  # what isn't the driver's own disk goes by Hadoop's file systems
    monkeypatch.setattr(st, "LOCK_S", 0)
    root = f"file://{tmp_path}"
    s = st.Store(spark, root, "ns")
    assert s.entries() == {} and s.put("a", spark.range(3), True) and s.get("a").count() == 3 and s.fresh("a")
    s.put("a", spark.range(4), True)
    assert s.get("a").count() == 4 and st.namespaces(root, spark) == ["ns"] and s.vacuum() == []
    s.put("b", spark.range(1), False)
    assert s.invalidate() == ["b"] and sorted(s.entries()) == ["a"]
    s.files.delete(f"{s.path}/{s.entries()['a']['path']}/_SUCCESS")
    assert code(s.get, "a") == "UNKNOWN_MATERIALIZED" and s.entries() == {} and len(s.vacuum()) == 1
    s.files.write(f"{s.path}/.lock", b"")
    assert code(s.put, "c", spark.range(1), True) == "STORE_LOCKED"
    s.files.delete(f"{s.path}/.lock")
    s.files.write(s._manifest, b"{")
    assert s.entries() == {}
    st.drop_namespace(root, "ns", spark)
    assert st.namespaces(root, spark) == []


def test_materialize_forms(shop, tmp_path):
    shop.materialize("q", query="SELECT status, count(*) AS n FROM shop.orders GROUP BY status")
    shop.materialize("f", path=f"{tmp_path}/customers.csv")
    shop.materialize("i", rows=b"a,b\n1,x\n", fmt="csv", namespace="other")
    assert rows(shop.query("SELECT * FROM materialized.q")) == [("paid", 3)] and shop.table("other.materialized.i").count() == 1
    assert rows(shop.query("SELECT a FROM other.materialized.i")) == [(1,)]
    shop.refresh_table("q")
    shop.drop_materialized("f")
    assert [e["name"] for e in shop.cache_entries() if e["pinned"]] == ["q"] and code(shop.query, "SELECT file.nope('x')") == "UNKNOWN_FUNCTION"
    assert format_rows(shop.table("materialized.q"), "ndjson") == '{"status":"paid","n":3}' and format_rows(shop.table("materialized.q"), "csv").startswith("status,n")
    assert encode("a-b.c") == "a_2d_b_2e_c"


def test_text_passes():
    assert sqltext.materialize_directive("-- x\n-- tributary: materialize t1\nSELECT 1") == "t1" and sqltext.materialize_directive("SELECT '-- tributary: materialize t'") is None
    assert sqltext.redact("SELECT a FROM s.t WHERE b = 'x' AND c > 5 -- hi") == "SELECT a FROM s.t WHERE b = '?' AND c > ? " and sqltext.redact("select 1 from a.b join c", "shape") == "SELECT a.b, c"
    assert sqltext.rewrite_dialect("SELECT unnest(generate_series(a, b, c)), from_json(x), from_json(x, 'a int'), 'unnest('") == "SELECT explode(sequence(a, b, c)), json_elements(x), from_json(x, 'a int'), 'unnest('"
    assert sqltext.rewrite_dialect("SELECT b.x FROM a RIGHT SEMI JOIN b ON a.x = b.x") == "SELECT b.x FROM b LEFT SEMI JOIN a ON a.x = b.x"
    assert code(sqltext.rewrite_dialect, "SELECT sum(x) OVER (ORDER BY y GROUPS 1 PRECEDING) FROM a JOIN b ON true") == "UNSUPPORTED"
    got = []
    assert sqltext.rewrite_calls("SELECT * FROM f.g(-1, 'a''b', NULL, 2.5) x, (SELECT 'f.g(1)') y", {"f.g"}, lambda c: got.append(c.args) or "V") == "SELECT * FROM V x, (SELECT 'f.g(1)') y"
    assert got == [[-1, "a'b", None, 2.5]] and code(sqltext.rewrite_calls, "SELECT * FROM a.b.c(1)", {"b.c"}, str) in ("INVALID_FUNCTION", "UNKNOWN_FUNCTION")


@pytest.mark.parametrize("sql, want", [
    ("SELECT * FROM t WHERE a = 'x' OR A = 'y' OR a = 3 ORDER BY 1", "SELECT * FROM t WHERE a IN ('x', 'y', 3) ORDER BY 1"),
    ("SELECT * FROM t WHERE (t.a = 1 OR t.a = 2) AND b = 3", "SELECT * FROM t WHERE (t.a IN (1, 2)) AND b = 3"),
    ("SELECT * FROM t WHERE a = 1 OR b = 2", None), ("SELECT * FROM t WHERE a = 1 OR a = 2 AND b = 3", None), ("SELECT * FROM t WHERE b = 1 AND a = 1 OR a = 2", None),
    ("SELECT * FROM t WHERE a = 1 OR a = 2 + 1", None), ("SELECT 'a = 1 OR a = 2'", None), ("SELECT * FROM t WHERE a = b OR a = c", None),
])
def test_or_chains(sql, want):
    assert sqltext.rewrite_or(sql) == (want or sql)


def test_or_reaches_the_api(spark, api, tmp_path):
    e = Engine(spark, {"sources": [{"name": "api", "kind": "http", "config": {**api, "tables": [spec("/echo", params=[{"name": "k", "required": True}])]}}]}, root=str(tmp_path))
    _Mock.seen.clear()
    assert sorted(r.k for r in e.query("SELECT id, k FROM api.t WHERE k = 'a' OR k = 'b'").collect()) == ["a", "b"]
    assert {"/echo?k=a", "/echo?k=b"} <= set(_Mock.seen)


def test_json_columns(spark):
    df = spark.createDataFrame([('{"a":{"b":"x","n":3,"t":true,"z":null,"s":"1.5","f":1.5}}', '[1,"a",null,{"k":1}]'), ("bad", "bad"), (None, None), ("[]", '{"a":1}')], "j string, a string")
    r = df.select(J.extract_string(df.j, "a.b"), J.extract_string(df.j, "a.n"), J.extract_string(df.j, "a.t"), J.extract_string(df.j, "a.z"), J.get_float(df.j, "a", "s"), J.get_float(df.j, "a", "f"), J.contains(df.j, "a", "z"), J.elements(df.a), J.length(df.a), J.get_json(df.j, "a", "b")).collect()
    assert tuple(r[0]) == ("x", "3", "true", None, None, 1.5, True, ["1", "a", "null", '{"k":1}'], 4, '"x"')
    assert tuple(r[1]) == (None, None, None, None, None, None, False, None, None, None) and r[2][7] is None and r[3][7] == ['{"a":1}'] and r[3][8] == 1


def test_declared_cells(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("3.9",), ("-3.9",), ('"7"',), ('"x"',), ("9999999999",), ("1e300",), ("true",), ("null",), ('{"a":1}',)], "j string").select(F.parse_json("j").alias("v"))
    assert [r[0] for r in df.select(json_cell(df.v, "int")).collect()] == [3, -3, 7, None, None, None, None, None, None]
    assert [r[0] for r in df.select(json_cell(df.v, "bigint")).collect()][4:6] == [9999999999, 2**63 - 1]
    assert [r[0] for r in df.select(json_cell(df.v, "varchar")).collect()][2] == "7" and [r[0] for r in df.select(json_cell(df.v, "varchar")).collect()][8] == '{"a":1}'


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x":1},{"x":2}]')
    (tmp_path / "b.ndjson").write_text('{"x":1}\n\n{"x":"y"}\n')
    (tmp_path / "c.json").write_text("5")
    assert fs.read_table(spark, str(tmp_path / "a.json")).count() == 2
    assert [r.x for r in fs.read_table(spark, str(tmp_path / "b.ndjson"), {"schema": [{"name": "x", "type": "bigint"}]}).collect()] == [1, None]
    assert [r.x for r in fs.read_table(spark, str(tmp_path / "a.json"), {"schema": [{"name": "x", "type": "varchar"}]}).collect()] == ["1", "2"]
    assert code(fs.read_table, spark, str(tmp_path / "c.json")) == "BAD_FORMAT" and code(fs.infer_format, "x.xyz") == "BAD_FORMAT" and fs.infer_format("s3://b/x.csv.gz", True) == "csv" and fs.infer_format("s3://b/x", True) == "parquet"
    assert code(fs.discover, str(tmp_path / "*.nothing")) == "SOURCE_REGISTRATION" and set(fs.discover(str(tmp_path / "*.json"))) == {"a", "c"}
    assert code(fs.read_table, spark, "x.parquet", {"partition_cols": [{"name": "a"}], "segments": [{"name": "b", "index": 0}]}) == "CONFIG_TABLE"
    (tmp_path / "p" / "eu" / "2024").mkdir(parents=True)
    (tmp_path / "p" / "eu" / "2024" / "f.csv").write_text("v\n1\n")
    got = fs.read_table(spark, f"{tmp_path}/p/*/*/f.csv", {"segments": [{"name": "r", "index": 0}, {"name": "y", "index": 1, "type": "int"}, {"name": "none", "index": 5}]}).collect()
    assert [tuple(r) for r in got] == [(1, "eu", 2024, "")]


class _Mock(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):  # noqa: N802
        u, q = urlsplit(self.path), {k: v for k, v in parse_qs(urlsplit(self.path).query).items()}
        _Mock.seen.append(self.path)
        link, status, data = None, 200, [{"id": k} for k in range(10)]
        at = lambda k, d: int(q.get(k, [d])[0])
        if u.path == "/cursor":
            k = at("cursor", 0)
            body = {"data": data[k : k + 4], "next": k + 4 if k + 4 < 10 else None}
        elif u.path == "/offset":
            body = data[at("offset", 0) :][: at("size", 4)]
        elif u.path == "/rowcursor":
            body = {"data": [x for x in data if x["id"] > at("after", -1)][:3], "more": at("after", -1) < 6}
        elif u.path == "/link":
            k = at("p", 0)
            body, link = data[k * 5 : k * 5 + 5], f'<http://127.0.0.1:{self.server.server_port}/link?p={k + 1}>; rel="next"; results="{"false" if k else "true"}"'
        elif u.path == "/flaky":
            _Mock.flaky = getattr(_Mock, "flaky", 0) + 1
            status, body = (503, {}) if _Mock.flaky < 3 else (200, [{"id": 1}])
        elif u.path == "/denied":
            status, body = 403, {"error": {"message": "no entry"}}
        elif u.path == "/echo":
            body = [{"id": 1, "q": q}]
        else:
            status, body = 404, {}
        raw = json.dumps(body).encode()
        self.send_response(status)
        if link:
            self.send_header("Link", link)
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def api():
    s = ThreadingHTTPServer(("127.0.0.1", 0), _Mock)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield {"name": "api", "base_url": f"http://127.0.0.1:{s.server_port}", "retry": {"base_seconds": 0.01}}
    s.shutdown()


def spec(path, **k):
    return {"name": "t", "path": path, "response": {"schema": [{"name": "id", "type": "bigint"}], **k.pop("response", {})}, **k}


@pytest.mark.parametrize("path, paging, rows_path", [
    ("/cursor", {"type": "cursor", "param": "cursor", "cursor_path": "$.next"}, "$.data"), ("/offset", {"type": "offset", "param": "offset", "size_param": "size", "size": 4}, "$"),
    ("/rowcursor", {"type": "row_cursor", "param": "after", "more_path": "$.more"}, "$.data"), ("/link", {"type": "link_header"}, "$"),
])
def test_pagination(api, path, paging, rows_path):
    s = spec(path, pagination=paging, response={"rows_path": rows_path})
    assert [r[0] for r in request.scan(s, api, {})] == list(range(10))
    assert len(list(request.scan(s, api, {}, limit=5))) == 5
    assert code(list, request.scan({**s, "safety": {"max_pages": 1}}, api, {})) == "SAFETY_TOO_MANY_PAGES"
    assert code(list, request.scan({**s, "safety": {"max_rows": 7}}, api, {})) == "SAFETY_TOO_MANY_ROWS"


def test_http_errors_and_binding(api, spark):
    assert [r[0] for r in request.scan(spec("/flaky"), api, {})] == [1]
    assert code(list, request.scan(spec("/denied", response={"errors": [{"status": "4xx", "message_path": "$.error.message"}]}), api, {})) == "SOURCE_FORBIDDEN"
    assert list(request.scan(spec("/none", response={"not_found_empty": True}), api, {})) == []
    s = spec("/echo", params=[{"name": "a", "accepts": {"gt": "a_min"}}, {"name": "b", "explode": True}, {"name": "c", "required": True, "column": "cc"}, {"name": "d", "derive": {"split": {"from": "c", "part": 1}}}, {"name": "e", "default": 5}])
    sets, rest = request.bind(s, [("a", "gt", 3), ("b", "in", [1, 2]), ("cc", "in", ["x/y", "z/w"]), ("id", "eq", 1)])
    assert sets == [{"a_min": 3, "b": [1, 2], "e": 5, "c": v} for v in ("x/y", "z/w")] and rest == [("id", "eq", 1)]
    assert code(request.bind, s, []) == "SAFETY_REQUIRED_FILTER"
    df = http.fetch(spark, api, s, [("cc", "eq", "k/v"), ("id", "eq", 1)])
    assert df.columns == ["id", "a", "b", "cc", "d", "e"] and df.first().cc == "k/v" and "d=v" in _Mock.seen[-1]
    assert request.matches(503, "5xx") and request.matches(404, ">=400") and not request.matches(200, 403)
    raw = http.read_table(spark, api, http.raw_spec("raw")).filter("request_path IN ('/none', '/echo')")
    assert sorted(r.response_status for r in raw.collect()) == [200, 404]
    assert code(guard.check_url, "http://169.254.169.254/x", api["base_url"]) == "SOURCE_FORBIDDEN" and code(guard.check_url, "http://127.0.0.1:1/x", "https://example.com") == "SOURCE_FORBIDDEN"
    b = request.build({"name": "t", "path": "/p/{x}", "params": [{"name": "x", "in": "path"}], "body": {"json": {"k": "{{k}}", "o": {"m": "{{m}}"}, "f": 1}}}, "http://h", {"x": "a b", "k": 2}, {"body": {"$.c.d": "t"}})
    assert b.full_url == "http://h/p/a%20b" and json.loads(b.data) == {"k": 2, "f": 1, "c": {"d": "t"}}


def test_computed_columns():
    row = {"a": {"b": 1}, "tags": [{"key": "x", "value": "1"}, {"key": "y", "value": "2"}, {"key": "x", "value": "3"}], "l": [1, None, "z"], "b64": "aGk=", "t": 1700000000, "u": {"k": {"v": 9}}}
    c = lambda e: extract.computed(e, row, {"p": "k"})
    assert c({"path": "a.b"}) == 1 and c("current_row") is row and c("null") is None and c({"from_filter": "p"}) == "k" and c({"literal": 4}) == 4
    assert c({"coalesce": [{"path": "zz"}, {"path": "a.b"}]}) == 1 and c({"to_timestamp": {"expr": {"path": "t"}}}) == "2023-11-14T22:13:20Z"
    assert c({"join": {"expr": {"path": "l"}}}) == "1,,z" and c({"map_join": {"expr": {"path": "tags"}, "item_path": "value"}}) == "1,2,3" and c({"first_of": {"expr": {"path": "tags"}, "item_path": "key"}}) == "x"
    assert c({"lookup": {"expr": {"path": "tags"}, "key": "y"}}) == "2" and c({"lookup_join": {"expr": {"path": "tags"}, "key": "x"}}) == "1,3" and c({"pick": {"expr": {"path": "u"}, "param": "p", "item_path": "v"}}) == 9
    assert c({"if_present": {"check": {"path": "a"}, "then_value": "yes"}}) == "yes" and c({"from_base64": {"path": "b64"}}) == "hi" and c({"replace": {"expr": {"literal": "aXb"}, "from": "X", "to": "-"}}) == "a-b" and c({"path": "a.q.r"}) is None
    assert extract.rows_at({"m": {"k": {"v": 1}, "s": 2}}, "$.m", "dict_entries") == [{"v": 1, "_key": "k"}, {"_key": "s", "_value": 2}]
    assert extract.rows_at([{"n": "a", "values": [[1, 2], [3, 4]]}], "$", "series_points") == [{"n": "a", "t": 1, "v": 2}, {"n": "a", "t": 3, "v": 4}]
    assert extract.rows_at(None) == [] and code(extract.rows_at, 5) == "SOURCE_SCHEMA_MISMATCH"
    assert extract.cell(3.9, "int") == 3 and extract.cell("5", "bigint") == 5 and extract.cell(2**40, "int") is None and extract.cell(" 1.5 ", "double") == 1.5 and extract.cell({"a": 1}, "varchar") == '{"a":1}' and extract.cell(5, "timestamp") is None
    assert extract.cell("2024-01-02T03:04:05+02:00", "timestamp") == datetime(2024, 1, 2, 1, 4, 5)


def test_openapi():
    doc = {"openapi": "3.0.1", "paths": {"/users/{id}": {"get": {"operationId": "getUser", "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "integer"}}], "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/U"}}}}}}},
           "/users": {"get": {"operationId": "listUsers", "tags": ["u"], "parameters": [{"name": "page", "in": "query", "schema": {"type": "integer"}}], "responses": {"200": {"content": {"application/json": {"schema": {"type": "object", "properties": {"items": {"type": "array", "items": {"$ref": "#/components/schemas/U"}}}}}}}}}}},
           "components": {"schemas": {"U": {"type": "object", "properties": {"id": {"type": "integer", "format": "int32"}, "at": {"type": "string", "format": "date-time"}, "x": {"type": "object"}}}}}}
    t = {x["name"]: x for x in openapi.synthesize({"spec": doc})}
    assert set(t) == {"get_user", "list_users"} and t["list_users"]["pagination"] == {"type": "page", "param": "page"} and t["list_users"]["response"]["rows_path"] == "$.items"
    assert [c["type"] for c in t["get_user"]["response"]["schema"]] == ["int", "timestamptz", "json"] and t["get_user"]["params"][0]["required"]
    assert len(openapi.synthesize({"spec": doc, "include": {"tags": ["u"]}})) == 1 and code(openapi.synthesize, {"spec": {"openapi": "3.1.0"}}) == "SOURCE_SCHEMA_MISMATCH"
    assert openapi.merge({"a": {"b": 1, "c": 2}, "l": [1], "pagination": {"type": "page"}}, {"a": {"b": None, "d": 3}, "l": [2], "pagination": {"type": "none"}}) == {"a": {"c": 2, "d": 3}, "l": [2], "pagination": {"type": "none"}}


def test_tool_server(spark):
    class Fake:
        def call(self, method, params):
            k = params["arguments"].get("cursor", 0)
            return {"structuredContent": {"rows": [{"v": k * 2}, {"v": k * 2 + 1}], "next": k + 1 if k < 2 else None}}

    tools = [{"name": "r", "annotations": {"readOnlyHint": True}, "inputSchema": {"properties": {"q": {"type": "integer"}}, "required": ["q"]}, "outputSchema": {"properties": {"rows": {"type": "array", "items": {"properties": {"v": {"type": "integer"}}}}}}},
             {"name": "w", "annotations": {"destructiveHint": True}}, {"name": "plain"}]
    assert [t["name"] for t in mcp.synthesize(tools)] == ["r"] and [t["name"] for t in mcp.synthesize(tools, "all")] == ["r", "plain"] and [t["name"] for t in mcp.synthesize(tools, "listed", include=["w"])] == ["w"]
    s = {**mcp.synthesize(tools)[0], "pagination": {"cursor_path": "$.next", "param": "cursor"}}
    assert [tuple(r) for r in mcp.fetch(spark, Fake(), s, [("q", "eq", 7), ("v", "gt", 3)]).collect()] == [(7, 4), (7, 5)]
    assert code(mcp.fetch, spark, Fake(), s, []) == "SAFETY_REQUIRED_FILTER"


def test_config(tmp_path, monkeypatch):
    (tmp_path / "b.yaml").write_text("sources:\n- {name: two, kind: file, config: {path: x.csv, token: '${secret:t}', other: 'a ${secret:t}'}}\n")
    (tmp_path / "a.yaml").write_text("version: 1\ninclude: [b.yaml]\nsources:\n- {name: one, kind: file, config: {path: /abs.csv, v: '${env:TRIB_X}'}}\n")
    monkeypatch.setenv("TRIB_X", "7")
    c = cfg.load(tmp_path / "a.yaml", {"t": "s3cr3t"})
    assert [s["name"] for s in c["sources"]] == ["one", "two"] and c["sources"][1]["config"] == {"path": str(tmp_path / "x.csv"), "token": "s3cr3t", "other": "a ${secret:t}"} and c["sources"][0]["config"]["v"] == "7"
    assert code(cfg.load, tmp_path / "a.yaml") == "CONFIG_UNRESOLVED_SECRET"
    (tmp_path / "c.yaml").write_text("include: [c.yaml]\n")
    assert code(cfg.load, tmp_path / "c.yaml") == "CONFIG_INCLUDE_CYCLE" and code(cfg.check, {"version": 9}) == "CONFIG_UNSUPPORTED_VERSION"
    assert code(cfg.check, {"sources": [{"name": "system", "kind": "file"}]}) == "CONFIG_SOURCE"


def test_cron_and_refresher():
    assert Cron("*/15 8-9 * * *").next(datetime(2024, 1, 1, 9, 50)) == datetime(2024, 1, 2, 8, 0)
    assert Cron("0 0 1 * 1").next(datetime(2024, 5, 2)) == datetime(2024, 5, 6) and Cron("5 4 29 2 *").next(datetime(2024, 3, 1)) == datetime(2028, 2, 29, 4, 5)
    assert code(Cron, "61 * * * *") == "CONFIG_DURATION" and code(Cron, "* *") == "CONFIG_DURATION"
    hits = []
    r = Refresher(lambda: hits.append(1), seconds=0.05).start()
    time.sleep(0.4)
    r.stop()
    assert hits


def test_cache_is_looked_at_on_each_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "ab.csv").write_text("x\n7\n")
    e = Engine(spark, {"sources": [{"name": "s", "kind": "file", "config": {"path": f"{tmp_path}/*.csv"}, "cache": {"ttl": "1h"}}]}, root=str(tmp_path / "store"))
    assert e.store.entries() == {}  # nothing is fetched before it is read
    assert rows(e.query("SELECT count(*) FROM s.a JOIN s.ab ON true")) == [(1,)] and sorted(e.store.entries()) == ["s.a", "s.ab"]
    old = e.store.entries()["s.ab"]["path"]
    (tmp_path / "a.csv").write_text("x\n1\n2\n")
    e.refresh_catalog()
    assert rows(e.query("SELECT count(*) FROM s.a")) == [(1,)]  # still fresh
    e.refresh_table("s.a")
    assert rows(e.query("SELECT count(*) FROM s.a")) == [(2,)] and e.store.entries()["s.ab"]["path"] == old  # only that table
    (tmp_path / "a.csv").write_text("x\n1\n2\n3\n")
    e.refresh_catalog()
    with e.store._locked() as m:
        m["s.a"]["written"] -= 4000
    assert rows(e.query("SELECT count(*) FROM s.a")) == [(3,)]  # over its time
    second = Engine(spark, e.config, root=e.root)
    assert rows(second.query("SELECT count(*) FROM s.a")) == [(3,)] and code(e.refresh_table, "s.zz") == "UNKNOWN_MATERIALIZED"


def test_refreshers_of_the_configuration(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    e = Engine(spark, {"sources": [{"name": "s", "kind": "file", "config": {"path": f"{tmp_path}/*.csv"}, "cache": {"ttl": "1h", "refresh": "200ms"}}]}, root=str(tmp_path / "store"))
    end = time.time() + 30
    while "s.a" not in e.store.entries() and time.time() < end:
        time.sleep(0.1)
    assert e.store.fresh("s.a") and not e.refreshers["s"][0].errors
    e.remove_source("s")
    assert e.refreshers == {}
    e.shutdown()


def test_dependent_join_in_sql(spark, api, tmp_path):
    (tmp_path / "k.csv").write_text("k\na\nb\nb\n")
    spec_ = spec("/echo", params=[{"name": "k", "required": True}])
    e = Engine(spark, {"sources": [{"name": "api", "kind": "http", "config": {**api, "tables": [spec_]}}, {"name": "f", "kind": "file", "config": {"path": f"{tmp_path}/*.csv"}}]}, root=str(tmp_path / "store"))
    _Mock.seen.clear()
    assert sorted(rows(e.query("SELECT d.k, t.id FROM f.k d JOIN api.t t ON t.k = d.k"))) == [("a", 1), ("b", 1), ("b", 1)]
    assert sorted(x for x in _Mock.seen if x.startswith("/echo")) == ["/echo?k=a", "/echo?k=b"]
    assert sorted(rows(e.query("WITH d AS (SELECT DISTINCT k FROM f.k WHERE k > 'a') SELECT d.k, x.id FROM api.t AS x JOIN d ON d.k = x.k"))) == [("b", 1)]
    assert rows(e.query("SELECT d.k FROM f.k d, api.t WHERE t.k = d.k AND d.k = 'a'")) == [("a",)]
    assert rows(e.query("SELECT d.k FROM f.k d JOIN api.t t ON t.k = d.k WHERE d.k = 'zz'")) == []


def test_json_and_array_calls(shop):
    one = lambda x: rows(shop.query(f"SELECT {x}"))[0][0]
    assert one("'[10,20]' -> 0") == "10" and one("'{\"a\":{\"b\":[1,2]}}' -> 'a' -> 'b' -> 1") == "2" and one("json_get_int('{\"a\":{\"b\":[1,2]}}', 'a', 'b', 1)") == 2
    assert one("json_get_str('{\"it''s\":\"x\"}', 'it''s')") == "x" and one("json_extract_string('{\"a\":[5]}', 'a[0]')") is None and one("json_length('{\"a\":[5,6]}', 'a')") == 2
    assert one("json_get_array('{\"a\":[5,null,\"x\"]}', 'a')") == ["5", "null", '"x"'] and one("json_get_float('{\"a\":\"1.5\"}', 'a')") is None and one("json_contains('bad', 'a')") is False
    assert one("array_remove(make_array(1, 2, 1), 1)") == [2, 1] and one("array_slice(make_array(1, 2, 3, 4), -3, -2)") == [2, 3] and one("array_slice(make_array(1, 2), 3, 1)") == [] and one("range(0)") == [] and one("range(5, 0, -2)") == [5, 3, 1]
    assert rows(shop.query("SELECT id FROM range(3) ORDER BY id DESC LIMIT 1")) == [(2,)] and code(shop.query, "SELECT json_get_int(status, id) FROM shop.orders") == "INVALID_ARGUMENT" and code(shop.query, "SELECT arrow_cast(1, 'Nope')") == "INVALID_ARGUMENT"


def test_metrics_read_rollups(shop):
    shop.catalog = Catalog.from_dict({**shop.config["semantic"], "metrics": [{"name": "twice", "kind": {"derived": {"expr": "{orders.revenue} * 2"}}}, {"name": "part", "kind": {"share": {"measure": "orders.revenue"}}}, {"name": "own", "kind": {"derived": {"expr": "{orders.revenue | total_amount > 150}"}}}]})
    asked = []
    c = shop.compiler()
    c.rollup = lambda m, p: asked.append(p) or shop._rollup(m, p)
    assert [tuple(r) for r in c.compile(Query(["twice", "part"], ["orders.status"])).collect()] == [("paid", 1400, 1.0)] and asked == ["by_status"]
    assert [tuple(r) for r in c.compile(Query(["own"], ["orders.status"])).collect()] == [("paid", 600)] and asked == ["by_status"]  # a filter that the roll-up can't apply
    assert [round(r[0], 6) for r in c.compile(Query(["part"], ["orders.at.month"], order_by=[("orders.at.month", "asc")])).select("part").collect()] == [0.142857, 0.285714, 0.571429]


def test_declared_file_functions(spark, tmp_path):
    (tmp_path / "eu.csv").write_text("id,name\n1,a\n2,b\n")
    f = {"source": "f", "name": "by_region", "path": f"{tmp_path}/{{region}}.csv", "args": [{"name": "region", "required": True}, {"name": "id", "type": "bigint", "column": "id"}], "returns": [{"name": "id", "type": "bigint"}, {"name": "name", "type": "varchar"}, {"name": "region", "type": "varchar", "source": "arg"}]}
    e = Engine(spark, {"sources": [{"name": "f", "kind": "file", "config": {"path": f"{tmp_path}/*.csv"}}], "functions": [f]}, root=str(tmp_path / "store"))
    assert rows(e.query("SELECT * FROM f.by_region('eu') ORDER BY id")) == [(1, "a", "eu"), (2, "b", "eu")] and rows(e.query("SELECT name FROM f.by_region('eu', 2)")) == [("b",)]
    e.reload_config({**e.config, "functions": []})
    assert "f.by_region" not in e.functions.functions


def test_embedded_files_are_scanned_in_place(spark, tmp_path, monkeypatch):
    import sqlite3

    import duckdb

    from tributary.sources import database, embedded

    monkeypatch.setattr(embedded, "ROWS", 3)
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, email TEXT, is_employee INTEGER)")
    con.executemany("INSERT INTO users VALUES (?, ?, ?)", [(k, None if k == 4 else f"u{k}@x", "no" if k == 5 else k % 2) for k in range(1, 9)])
    con.execute("CREATE VIEW v AS SELECT id FROM users")
    con.commit()
    con.close()
    t = database.sqlite_tables(spark, {"path": str(tmp_path / "a.db")})
    assert t["users"].rdd.getNumPartitions() == 3 and t["users"].count() == 8 and t["v"].count() == 8
    assert [tuple(r) for r in t["users"].filter("id IN (4, 5) OR id = 7").orderBy("id").collect()] == [(4, None, 0), (5, "u5@x", None), (7, "u7@x", 1)]
    assert [r.id for r in t["users"].filter("id > 6 AND email IS NOT NULL").orderBy("id").collect()] == [7, 8] and [r.id for r in t["users"].filter("is_employee IS NULL").collect()] == [5]
    reader = embedded.EmbeddedReader({"db": "sqlite", "file": str(tmp_path / "a.db"), "query": "SELECT * FROM users", "table": "users"}, t["users"].schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert len(list(reader.pushFilters([EqualTo(("id",), 3), GreaterThan(("email",), "a")]))) == 2 and reader.where == ['"id" = ?']
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1]
    handed = database.sqlite_tables(spark, {"path": str(tmp_path / "a.db"), "shared": False})["users"]
    assert sorted(map(tuple, handed.collect()), key=str) == sorted(map(tuple, t["users"].collect()), key=str)
    con = duckdb.connect(f"{tmp_path}/a.duckdb")
    con.execute("CREATE TABLE t AS SELECT i, 'n' || i AS name, i * 1.5::DOUBLE AS d, DATE '2024-01-01' + CAST(i AS INTEGER) AS day, [i] AS l FROM range(7) x(i)")
    con.close()
    d = database.duckdb_tables(spark, {"path": f"{tmp_path}/a.duckdb"})["t"]
    assert d.rdd.getNumPartitions() == 3 and [(r.i, r.name, r.d, str(r.day), r.l) for r in d.filter("name = 'n4' AND i >= 2").collect()] == [(4, "n4", 6.0, "2024-01-05", [4])]
    assert d.select("name").filter("name IN ('n1', 'n2')").count() == 2
    q = database.duckdb_tables(spark, {"path": f"{tmp_path}/a.duckdb", "tables": [{"name": "q", "query": "SELECT i + 1 AS j FROM t"}]})["q"]
    assert q.filter("j = 7").count() == 1


def test_database_discovery(spark, monkeypatch):
    from tributary.sources import database

    assert "table_schema = 'shop'" in database.discovery_query("mysql", {"database": "shop"}) and "NOT IN" in database.discovery_query("postgres", {}) and "'x'" in database.discovery_query("snowflake", {"schema": "x"})

    class Fake:
        def __getattr__(self, name):
            return lambda *a, **k: self

        def collect(self):
            return [("a", "t"), ("a", "u"), ("b", "t")]

    assert database.discovered(type("S", (), {"read": Fake()}), "postgres", {"host": "h", "database": "d"}) == [{"name": "a__t", "table": "a.t"}, {"name": "u", "table": "a.u"}, {"name": "b__t", "table": "b.t"}]
    assert code(database.jdbc_tables("postgres"), spark, {"host": "127.0.0.1", "database": "d"}) == "SOURCE_UNREACHABLE"


@pytest.mark.parametrize("path, storage, key", [
    ("s3://b/x", {"type": "access_key", "access_key_id": "a", "secret_access_key": "s", "region": "eu"}, "fs.s3a.bucket.b.access.key"), ("gs://b/x", {"type": "service_account", "key_file": "/k.json"}, "fs.gs.auth.service.account.json.keyfile"),
    ("az://c@acc.dfs.core.windows.net/x", {"type": "sas", "sas_token": "t"}, "fs.azure.sas.fixed.token.acc.dfs.core.windows.net"), ("abfss://c@acc.dfs.core.windows.net/x", {"type": "access_key", "account_key": "k"}, "fs.azure.account.key.acc.dfs.core.windows.net"),
    ("abfss://c@acc.dfs.core.windows.net/x", {"type": "service_principal", "client_id": "i", "client_secret": "s", "tenant_id": "t"}, "fs.azure.account.oauth2.client.id.acc.dfs.core.windows.net"),
])
def test_credentials(spark, path, storage, key):
    got = fs.credentials(spark, path, storage)
    assert key in got and spark.sparkContext._jsc.hadoopConfiguration().get(key) == got[key]
