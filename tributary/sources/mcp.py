"""Tools of a tool server as tables: arguments are bound by equality filters and echoed as columns."""

from __future__ import annotations

import fnmatch
import itertools
import json
import subprocess
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.errors import EngineError
from tributary.sources.http import extract
from tributary.sources.types import struct_of

#: Pages of one call before it counts as endless.
MAX_PAGES = 1000


class HttpClient:
    """JSON-RPC over http."""

    def __init__(self, url: str, headers: dict | None = None):
        self.url, self.headers, self.ids = url, headers or {}, itertools.count(1)

    def call(self, method: str, params: dict) -> dict:
        body = json.dumps({"jsonrpc": "2.0", "id": next(self.ids), "method": method, "params": params}).encode()
        req = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Accept": "application/json", **self.headers})
        with urllib.request.urlopen(req, timeout=60) as r:
            out = json.loads(r.read())
        if "error" in out:
            raise EngineError("SOURCE_OTHER", f"{method}: {out['error'].get('message')}")
        return out.get("result", {})


class StdioClient(HttpClient):
    """JSON-RPC over a child process, one message a line."""

    def __init__(self, command: list[str]):
        self.ids = itertools.count(1)
        self.run = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)

    def call(self, method: str, params: dict) -> dict:
        n = next(self.ids)
        self.run.stdin.write(json.dumps({"jsonrpc": "2.0", "id": n, "method": method, "params": params}) + "\n")
        self.run.stdin.flush()
        for line in self.run.stdout:
            out = json.loads(line)
            if out.get("id") == n:
                if "error" in out:
                    raise EngineError("SOURCE_OTHER", f"{method}: {out['error'].get('message')}")
                return out.get("result", {})
        raise EngineError("SOURCE_UNREACHABLE", "the tool server ended")


def column_type(schema: dict) -> str:
    return {"integer": "bigint", "number": "double", "boolean": "boolean"}.get(schema.get("type"), "varchar")


def synthesize(tools: list[dict], expose: str = "read_only", include: list[str] = (), exclude: list[str] = ()) -> list[dict]:
    """Table declarations of ``tools/list``; destructive tools are never exposed unless listed by name, and read_only asks for the hint."""
    out = []
    for t in tools:
        hints, name = t.get("annotations", {}), t["name"]
        by_name = any(fnmatch.fnmatch(name, g) for g in include)
        if any(fnmatch.fnmatch(name, g) for g in exclude) or (include and not by_name):
            continue
        if expose == "listed" and not by_name or expose == "read_only" and not hints.get("readOnlyHint") or hints.get("destructiveHint") and name not in include:
            continue
        schema = t.get("inputSchema", {})
        args = [{"name": n, "type": column_type(s), "required": n in schema.get("required", [])} for n, s in schema.get("properties", {}).items()]
        props = t.get("outputSchema", {}).get("properties", {})
        arrays = [n for n, s in props.items() if s.get("type") == "array"]
        row = props[arrays[0]].get("items", {}).get("properties", {}) if len(arrays) == 1 else {}
        cols = [{"name": n, "type": column_type(s) if s.get("type") not in ("object", "array") else "json"} for n, s in row.items()]
        out.append({"name": name, "tool": name, "args": args, "rows_path": f"$.{arrays[0]}" if len(arrays) == 1 else None, "columns": cols or [{"name": "result", "type": "json", "source": "$"}]})
    return out


def _payload(result: dict):
    if result.get("isError"):
        raise EngineError("SOURCE_OTHER", str(result.get("content"))[:300])
    if "structuredContent" in result:
        return result["structuredContent"]
    texts = [c["text"] for c in result.get("content", []) if c.get("type") == "text"]
    if len(texts) == 1:
        try:
            return json.loads(texts[0])
        except ValueError:
            return texts[0]
    return texts


def _rows(body, path: str | None) -> list:
    if path:
        return extract.rows_at(body, path)
    if isinstance(body, dict):
        arrays = [v for v in body.values() if isinstance(v, list)]
        return arrays[0] if len(arrays) == 1 else [body]
    return body if isinstance(body, list) else [body]


def call_rows(client: HttpClient, spec: dict, args: dict, limit: int | None = None) -> Iterator[tuple]:
    """Rows of one call: the arguments first, then the columns; pages follow the cursor until it is absent or stays."""
    missing = [a["name"] for a in spec["args"] if a.get("required") and a["name"] not in args]
    if missing:
        raise EngineError("SAFETY_REQUIRED_FILTER", f"{spec['name']} needs a filter on {', '.join(missing)}")
    send, n, cursor = dict(args), 0, None
    if limit is not None and spec.get("limit_binding"):
        send[spec["limit_binding"]] = limit
    p = spec.get("pagination", {})
    for _ in range(spec.get("max_pages", MAX_PAGES)):
        body = _payload(client.call("tools/call", {"name": spec["tool"], "arguments": send}))
        for row in _rows(body, spec.get("rows_path")):
            if limit is not None and n >= limit:
                return
            n += 1
            echoed = tuple(extract.cell(args.get(a["name"]), a["type"]) for a in spec["args"])
            yield echoed + extract.row_values(row, spec["columns"], args)
        nxt = extract.walk(body, p["cursor_path"]) if p else None
        if not p or nxt in (None, "", cursor):
            return
        cursor = send[p["param"]] = nxt
    raise EngineError("SAFETY_TOO_MANY_PAGES", spec["name"])


def schema_of(spec: dict):
    args = [a for a in spec["args"] if a["name"] not in {c["name"] for c in spec["columns"]}]
    return struct_of([*args, *spec["columns"]])


def fetch(spark: SparkSession, client: HttpClient, spec: dict, filters: list[tuple[str, str, object]], limit: int | None = None) -> DataFrame:
    """The tool's rows; equality filters are bound as arguments and checked again on the echoed columns, the others are applied to the rows."""
    names = {a["name"] for a in spec["args"]}
    bound = {c: v for c, op, v in filters if op == "eq" and c in names}
    own = {c["name"] for c in spec["columns"]}
    keep = [k for k, a in enumerate(spec["args"]) if a["name"] not in own]
    rows = [tuple(r[k] for k in keep) + r[len(spec["args"]) :] for r in call_rows(client, spec, bound, limit if len(bound) == len(filters) else None)]
    df = spark.createDataFrame(rows, schema_of(spec))
    ops: dict[str, Callable] = {"eq": lambda c, v: c == v, "in": lambda c, v: c.isin(list(v)), "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
    for c, op, v in filters:
        df = df.filter(ops[op](F.col(c), v))
    return df.limit(limit) if limit is not None else df


def client_of(config: dict) -> HttpClient:
    return StdioClient(config["command"]) if config.get("command") else HttpClient(config["url"], config.get("headers"))


def tables(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Tools that need no argument as ready tables; the others are called through ``fetch`` or a declared function."""
    client = client_of(config)
    specs = {t["name"]: t for t in synthesize(client.call("tools/list", {}).get("tools", []), config.get("expose", "read_only"), config.get("include", []), config.get("exclude", []))}
    specs |= {t["name"]: t for t in config.get("tables", [])}
    return {n: fetch(spark, client, s, []) for n, s in specs.items() if not any(a.get("required") for a in s["args"])}
