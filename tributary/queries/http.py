"""API tables: binding, paging, reshaping, computed columns, guards and documents, each against an API that serves the nation table in another way."""

from __future__ import annotations

import base64
import functools
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from tributary.queries.tables import table
from tributary.service import Engine
from tributary.sources import mcp
from tributary.sources.http import table as http


def _answer(path: str, q: dict, body: dict, data: list[dict], port: int, state: dict) -> tuple[int, object, str | None]:
    """Status, body and Link header of one request."""
    at = lambda k, d: int(q.get(k, [d])[0])
    if path == "/cursor":
        k = at("cursor", 0)
        return 200, {"data": data[k : k + 4], "next": k + 4 if k + 4 < len(data) else None}, None
    if path == "/offset":
        return 200, data[at("offset", 0) :][: at("size", 4)], None
    if path == "/rowcursor":
        return 200, {"data": [x for x in data if x["id"] > at("after", -1)][:3], "more": at("after", -1) < len(data) - 4}, None
    if path == "/link":
        k = at("p", 0)
        return 200, data[k * 5 : k * 5 + 5], f'<http://127.0.0.1:{port}/link?p={k + 1}>; rel="next"; results="{"true" if k * 5 + 5 < len(data) else "false"}"'
    if path == "/bodycursor":
        k = int(body.get("page", {}).get("cursor", 0))
        own = [x for x in data if "region" not in body or x["region"] == int(body["region"])]
        return 200, {"rows": own[k : k + 2], "meta": {"next": k + 2 if k + 2 < len(own) else None}, "keys": sorted(body)}, None
    if path == "/range":
        return 200, [x for x in data if at("min_id", -1) < x["id"] <= at("max_id", 10**6)], None
    if path == "/many":
        return 200, [x for x in data if str(x["id"]) in q.get("id", [])], None
    if path == "/echo":
        return 200, [{"id": 1, **{k: ",".join(v) for k, v in q.items()}}], None
    if path == "/dict":
        return 200, {"m": {x["name"]: {"id": x["id"], "region": x["region"]} for x in data}}, None
    if path == "/scalars":
        return 200, {"m": {x["name"]: x["id"] for x in data}}, None
    if path == "/series":
        return 200, [{"region": r, "values": [[x["id"], x["id"] * 10 + r] for x in data if x["region"] == r]} for r in sorted({x["region"] for x in data})], None
    if path == "/nested":
        out = []
        for x in data:
            tags = [{"key": "k", "value": x["name"]}, {"key": "z", "value": "q"}, {"key": "k", "value": f"r{x['region']}"}]
            out.append({"a": {"b": x["id"]}, "tags": tags, "l": [x["id"], None, x["name"]], "b64": base64.b64encode(x["name"].encode()).decode(), "t": 1_700_000_000 + x["id"], "u": {"x": {"v": x["id"] * 2}}, **({"opt": x["id"]} if x["id"] % 2 == 0 else {})})
        return 200, out, None
    if path == "/flaky":
        state["n"] = state.get("n", 0) + 1
        return (503, {}, None) if state["n"] % 3 else (200, data, None)
    if path == "/denied":
        return 403, {"error": {"message": "no entry"}}, None
    if path == "/one":
        return 200, {"r": data[3]}, None
    if path == "/null":
        return 200, {"r": None}, None
    if path.startswith("/region/"):
        return 200, [x for x in data if x["region"] == int(path.rsplit("/", 1)[1])], None
    if path == "/all":
        return 200, data, None
    if path == "/rpc":
        args = body.get("params", {}).get("arguments", {})
        tools = [{"name": "nations", "annotations": {"readOnlyHint": True}, "inputSchema": {"properties": {"region": {"type": "integer"}}}, "outputSchema": {"properties": {"rows": {"type": "array", "items": {"properties": {"id": {"type": "integer"}, "name": {"type": "string"}}}}}}},
                 {"name": "drop_all", "annotations": {"destructiveHint": True}}]
        own = [x for x in data if "region" not in args or x["region"] == args["region"]]
        k = args.get("cursor", 0)
        result = {"tools": tools} if body.get("method") == "tools/list" else {"structuredContent": {"rows": [{"id": x["id"], "name": x["name"]} for x in own[k : k + 3]], "next": k + 3 if k + 3 < len(own) else None}}
        return 200, {"jsonrpc": "2.0", "id": body.get("id"), "result": result}, None
    return 404, {}, None


class _Handler(BaseHTTPRequestHandler):
    data: list[dict] = []
    state: dict = {}

    def _serve(self) -> None:
        u = urlsplit(self.path)
        size = int(self.headers.get("Content-Length") or 0)
        sent = json.loads(self.rfile.read(size)) if size else {}
        status, body, link = _answer(u.path, parse_qs(u.query), sent, self.data, self.server.server_port, self.state)
        raw = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        if link:
            self.send_header("Link", link)
        self.end_headers()
        self.wfile.write(raw)

    do_GET = do_POST = _serve  # noqa: N815

    def log_message(self, *_):
        pass


@functools.cache
def serve(rows: tuple) -> str:
    handler = type("Handler", (_Handler,), {"data": [dict(zip(("id", "name", "region"), r)) for r in rows], "state": {}})
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_port}"


def _base(spark: SparkSession, d: str) -> str:
    return serve(tuple((r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in table(spark, d, "nation").orderBy("n_nationkey").collect()))


_COLS = [{"name": "id", "type": "bigint"}, {"name": "name", "type": "varchar"}, {"name": "region", "type": "int"}]


def _spec(path: str, rows_path: str = "$", schema: list | None = None, **more) -> dict:
    return {"name": "t", "path": path, "response": {"rows_path": rows_path, "schema": schema or _COLS, **more.pop("response", {})}, **more}


def _case(sql: str, spec: dict | None = None, **source):
    def run(spark: SparkSession, d: str) -> DataFrame:
        config = {"base_url": _base(spark, d), "retry": {"base_seconds": 0.01}, **({"tables": [spec]} if spec else {}), **source}
        return Engine(spark, {"sources": [{"name": "api", "kind": "http", "config": config}]}).query(sql).df

    return run


_ALL = "SELECT id, name, region FROM api.t"
_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_regionkey AS region FROM nation"
_IDS = "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation"


def _computed() -> list[dict]:
    e = {
        "path": ({"path": "a.b"}, "bigint"), "row_text": ("current_row", "varchar"), "nothing": ("null", "varchar"), "asked": ({"from_filter": "p"}, "varchar"), "first_known": ({"coalesce": [{"path": "zz"}, {"path": "opt"}, {"path": "t"}]}, "bigint"),
        "at": ({"to_timestamp": {"expr": {"path": "t"}}}, "varchar"), "joined": ({"join": {"expr": {"path": "l"}}}, "varchar"), "mapped": ({"map_join": {"expr": {"path": "tags"}, "item_path": "value", "separator": "|"}}, "varchar"),
        "first_tag": ({"first_of": {"expr": {"path": "tags"}, "item_path": "value"}}, "varchar"), "looked": ({"lookup": {"expr": {"path": "tags"}, "key": "z"}}, "varchar"), "looked_all": ({"lookup_join": {"expr": {"path": "tags"}, "key": "k"}}, "varchar"),
        "picked": ({"pick": {"expr": {"path": "u"}, "param": "p", "item_path": "v"}}, "bigint"), "fixed": ({"literal": 4}, "int"), "has_opt": ({"if_present": {"check": {"path": "opt"}, "then_value": "yes"}}, "varchar"), "decoded": ({"from_base64": {"path": "b64"}}, "varchar"),
        "replaced": ({"replace": {"expr": {"path": "b64"}, "from": "=", "to": "-"}}, "varchar"),
    }
    return [{"name": n, "type": t, "expr": x} for n, (x, t) in e.items()]


def http_guards(spark: SparkSession, d: str) -> DataFrame:
    """Codes of what an API table refuses: an open required column, too many pages or rows, an error status, a foreign or private address."""
    source = {"name": "api", "base_url": _base(spark, d), "retry": {"base_seconds": 0.01}}
    pages = {"type": "cursor", "param": "cursor", "cursor_path": "$.next"}
    cases = {
        "required": _spec("/all", params=[{"name": "k", "required": True}]), "pages": _spec("/cursor", "$.data", pagination=pages, safety={"max_pages": 2}), "rows": _spec("/cursor", "$.data", pagination=pages, safety={"max_rows": 5}),
        "denied": _spec("/denied", response={"errors": [{"status": "4xx", "message_path": "$.error.message"}]}), "not_found": _spec("/nowhere"), "fits": _spec("/all"),
    }
    out = []
    for name, spec in cases.items():
        try:
            out.append((name, f"{http.fetch(spark, source, spec, []).count()} rows"))
        except Exception as e:
            out.append((name, getattr(e, "code", type(e).__name__)))
    for name, url in (("metadata_address", "http://169.254.169.254"), ("private_address", "http://10.0.0.1")):
        from tributary.sources.http import guard

        try:
            guard.check_url(url + "/x", "https://example.com")
            out.append((name, "allowed"))
        except Exception as e:
            out.append((name, getattr(e, "code", type(e).__name__)))
    return spark.createDataFrame(out, "case_name string, outcome string")


def http_limit(spark: SparkSession, d: str) -> DataFrame:
    """A limit ends paging: the pages behind it aren't asked for, though the table allows only two pages."""
    spec = _spec("/cursor", "$.data", pagination={"type": "cursor", "param": "cursor", "cursor_path": "$.next"}, safety={"max_pages": 2})
    return http.fetch(spark, {"name": "api", "base_url": _base(spark, d)}, spec, [], limit=7)


def http_openapi(spark: SparkSession, d: str) -> DataFrame:
    """Tables of an OpenAPI document, one of them patched: by-region with its path parameter bound by an IN list."""
    item = {"type": "object", "properties": {"id": {"type": "integer"}, "name": {"type": "string"}, "region": {"type": "integer", "format": "int32"}, "extra": {"type": "object"}}}
    ok = lambda s: {"200": {"content": {"application/json": {"schema": s}}}}
    doc = {"openapi": "3.0.1", "paths": {
        "/region/{r}": {"get": {"operationId": "byRegion", "parameters": [{"name": "r", "in": "path", "required": True, "schema": {"type": "integer"}}], "responses": ok({"type": "array", "items": {"$ref": "#/components/schemas/N"}})}},
        "/all": {"get": {"operationId": "listAll", "tags": ["hidden"], "responses": ok({"type": "array", "items": {"$ref": "#/components/schemas/N"}})}}}, "components": {"schemas": {"N": item}}}
    patch = {"name": "by_region", "response": {"schema": [*_COLS, {"name": "upper_name", "type": "varchar", "source": "$.name"}]}}
    e = Engine(spark, {"sources": [{"name": "api", "kind": "http", "config": {"base_url": _base(spark, d), "openapi": {"spec": doc, "exclude": {"tags": ["hidden"]}}, "tables": [patch]}}]})
    return e.query("SELECT id, upper_name, r, size(array('" + "','".join(e.list_tables()) + "')) AS tables FROM api.by_region WHERE r IN (1, 3)").df


def tool_table(spark: SparkSession, d: str) -> DataFrame:
    """A tool server's read-only tools as tables, and one with its argument bound and its pages followed."""
    client = mcp.HttpClient(_base(spark, d) + "/rpc")
    (spec,) = mcp.synthesize(client.call("tools/list", {})["tools"])
    spec = {**spec, "pagination": {"cursor_path": "$.next", "param": "cursor"}}
    return mcp.fetch(spark, client, spec, [("region", "eq", 2), ("id", "gt", 3)])


def fn_declared_http(spark: SparkSession, d: str) -> DataFrame:
    """A declared function over an API beside the built-in http.get."""
    base = _base(spark, d)
    f = {"source": "api", "name": "of_region", "path": "/region/{r}", "args": [{"name": "r", "type": "int", "required": True}, {"name": "note", "default": "n"}], "returns": [{"name": "id", "type": "bigint"}, {"name": "r", "type": "int", "source": "arg"}, {"name": "note", "type": "varchar", "source": "arg"}]}
    e = Engine(spark, {"sources": [{"name": "api", "kind": "http", "config": {"base_url": base, "tables": []}}], "functions": [f], "allowed_hosts": ["127.0.0.1"]})
    return e.query(f"SELECT f.id, f.r, f.note, g.n FROM api.of_region(2) f CROSS JOIN (SELECT count(*) AS n FROM http.get('{base}/all', '$')) g").df


_PAGED = {
    "http_cursor": _spec("/cursor", "$.data", pagination={"type": "cursor", "param": "cursor", "cursor_path": "$.next"}), "http_offset": _spec("/offset", pagination={"type": "offset", "param": "offset", "size_param": "size", "size": 4}),
    "http_row_cursor": _spec("/rowcursor", "$.data", pagination={"type": "row_cursor", "param": "after", "more_path": "$.more"}), "http_link": _spec("/link", pagination={"type": "link_header"}),
    "http_body_cursor": _spec("/bodycursor", "$.rows", pagination={"type": "body_cursor", "cursor_path": "page.cursor", "next_path": "$.meta.next"}, method="POST", body={"json": {"region": "{{region}}", "x": {"y": "{{z}}"}, "k": 1}}, params=[{"name": "region", "type": "int", "filterable": True}]),
    "http_retry": _spec("/flaky"),
}
_NOT_FOUND = _spec("/nowhere", response={"not_found_empty": True})
QUERIES = {n: _case(_ALL, s) for n, s in _PAGED.items()} | {
    "http_body": _case(_ALL + " WHERE region = 3", _PAGED["http_body_cursor"]),
    "http_compare": _case("SELECT id FROM api.t WHERE id > 4 AND id <= 9", _spec("/range", params=[{"name": "id", "type": "bigint", "accepts": {"gt": "min_id", "lte": "max_id"}}])),
    "http_explode": _case(_ALL + " WHERE id IN (2, 5, 7) AND name <> 'NATION_5'", _spec("/many", params=[{"name": "id", "type": "bigint", "explode": True}])),
    "http_product": _case("SELECT a, b, c FROM api.t WHERE a IN ('x', 'y') AND (b = '1' OR b = '2') AND c = 'k'", _spec("/echo", schema=[{"name": "id", "type": "bigint"}], params=[{"name": "a"}, {"name": "b"}, {"name": "c"}])),
    "http_not_in": _case("SELECT id FROM api.t WHERE region NOT IN (0, 1)", _spec("/all", params=[{"name": "region", "type": "int"}])),
    "http_defaults": _case("SELECT got_b, got_d, c FROM api.t WHERE c = 'x/y'", _spec("/echo", schema=[{"name": "got_b", "type": "varchar", "source": "$.b"}, {"name": "got_d", "type": "varchar", "source": "$.d"}], params=[{"name": "b", "default": "5"}, {"name": "c", "required": True}, {"name": "d", "derive": {"split": {"from": "c", "part": 1}}}])),
    "http_conditional": _case("SELECT id, r FROM api.t WHERE r = 4", _spec("/all", params=[{"name": "r", "type": "int"}], requests=[{"when_filters": ["r"], "path": "/region/{r}"}])),
    "http_dict_entries": _case("SELECT key, id, region FROM api.t", _spec("/dict", "$.m", [{"name": "key", "type": "varchar", "source": "$._key"}, *[c for c in _COLS if c["name"] != "name"]], response={"reshape": "dict_entries"})),
    "http_dict_scalars": _case("SELECT k, v FROM api.t", _spec("/scalars", "$.m", [{"name": "k", "type": "varchar", "source": "$._key"}, {"name": "v", "type": "bigint", "source": "$._value"}], response={"reshape": "dict_entries"})),
    "http_series": _case("SELECT region, t, v FROM api.t", _spec("/series", schema=[{"name": "region", "type": "int"}, {"name": "t", "type": "bigint"}, {"name": "v", "type": "double"}], response={"reshape": "series_points"})),
    "http_lone_and_null": _case("SELECT id, name, region FROM api.one UNION ALL SELECT id, name, region FROM api.nothing UNION ALL SELECT id, name, region FROM api.lost", tables=[{**_spec("/one", "$.r"), "name": "one"}, {**_spec("/null", "$.r"), "name": "nothing"}, {**_NOT_FOUND, "name": "lost"}]),
    "http_computed": _case("SELECT path, length(row_text) > 20 AS row_text, nothing, asked, first_known, at, joined, mapped, first_tag, looked, looked_all, picked, fixed, has_opt, decoded, replaced FROM api.t WHERE p = 'x'", _spec("/nested", schema=_computed(), params=[{"name": "p"}])),
    "http_raw": _case("SELECT request_path, request_query, response_status, length(response_body) > 2 AS body FROM api.api WHERE request_path IN ('/region/2', '/nowhere') AND request_query = 'x=1'"),
    **{f.__name__: f for f in (http_guards, http_limit, http_openapi, tool_table, fn_declared_http)},
}
ORACLE = {n: _NATION for n in _PAGED} | {
    "http_body": _NATION + " WHERE n_regionkey = 3", "http_compare": _IDS + " WHERE n_nationkey > 4 AND n_nationkey <= 9", "http_explode": _NATION + " WHERE n_nationkey IN (2, 7)",
    "http_product": "SELECT a, b, 'k' AS c FROM (VALUES ('x'), ('y')) t(a), (VALUES ('1'), ('2')) u(b)", "http_not_in": _IDS + " WHERE n_regionkey NOT IN (0, 1)", "http_defaults": "SELECT '5' AS got_b, 'y' AS got_d, 'x/y' AS c",
    "http_conditional": "SELECT CAST(n_nationkey AS BIGINT) AS id, 4 AS r FROM nation WHERE n_regionkey = 4", "http_dict_entries": "SELECT n_name AS key, CAST(n_nationkey AS BIGINT) AS id, n_regionkey AS region FROM nation",
    "http_dict_scalars": "SELECT n_name AS k, CAST(n_nationkey AS BIGINT) AS v FROM nation", "http_series": "SELECT n_regionkey AS region, CAST(n_nationkey AS BIGINT) AS t, CAST(n_nationkey * 10 + n_regionkey AS DOUBLE) AS v FROM nation", "http_lone_and_null": _NATION + " WHERE n_nationkey = 3",
    "http_computed": """SELECT CAST(n_nationkey AS BIGINT) AS path, true AS row_text, CAST(NULL AS VARCHAR) AS nothing, 'x' AS asked, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 1700000000 + n_nationkey END AS BIGINT) AS first_known,
        strftime(make_timestamp((1700000000 + n_nationkey) * 1000000::BIGINT), '%Y-%m-%dT%H:%M:%SZ') AS at, n_nationkey || ',,' || n_name AS joined, n_name || '|q|r' || n_regionkey AS mapped, n_name AS first_tag, 'q' AS looked, n_name || ',r' || n_regionkey AS looked_all,
        CAST(n_nationkey * 2 AS BIGINT) AS picked, 4 AS fixed, CASE WHEN n_nationkey % 2 = 0 THEN 'yes' END AS has_opt, n_name AS decoded, replace(to_base64(encode(n_name)), '=', '-') AS replaced FROM nation""",
    "http_raw": "SELECT * FROM (VALUES ('/region/2', 'x=1', 200, true), ('/nowhere', 'x=1', 404, false)) t(request_path, request_query, response_status, body)",
    "http_guards": "SELECT * FROM (VALUES ('required', 'SAFETY_REQUIRED_FILTER'), ('pages', 'SAFETY_TOO_MANY_PAGES'), ('rows', 'SAFETY_TOO_MANY_ROWS'), ('denied', 'SOURCE_FORBIDDEN'), ('not_found', 'SOURCE_OTHER'), ('fits', (SELECT count(*) FROM nation) || ' rows'), ('metadata_address', 'SOURCE_FORBIDDEN'), ('private_address', 'SOURCE_FORBIDDEN')) t(case_name, outcome)",
    "http_limit": _NATION + " WHERE n_nationkey < 7", "http_openapi": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS upper_name, CAST(n_regionkey AS BIGINT) AS r, 1 AS tables FROM nation WHERE n_regionkey IN (1, 3)",
    "tool_table": "SELECT CAST(2 AS BIGINT) AS region, CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 3",
    "fn_declared_http": "SELECT CAST(n_nationkey AS BIGINT) AS id, 2 AS r, 'n' AS note, (SELECT count(*) FROM nation) AS n FROM nation WHERE n_regionkey = 2",
}
