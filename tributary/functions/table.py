"""Table functions ``namespace.function(literals)``: the registry, argument binding, and the built-in ones over files and http."""

from __future__ import annotations

import glob as globbing
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.plans.sqltext import SqlError
from tributary.sources.http import extract, request
from tributary.sources.types import spark_type, struct_of

_REQUIRED = object()


@dataclass
class Argument:
    name: str
    type: str = "varchar"
    default: object = _REQUIRED


@dataclass
class TableFunction:
    name: str
    args: list[Argument]
    returns: list[dict]
    run: Callable[..., DataFrame] = field(repr=False, default=None)
    description: str = ""

    def bind(self, given: list) -> dict:
        """Arguments by position; NULL counts as not given; what is missing takes its default."""
        if len(given) > len(self.args):
            raise SqlError("INVALID_ARGUMENT", f"{self.name} takes {len(self.args)} arguments, got {len(given)}")
        out = {}
        for k, a in enumerate(self.args):
            v = given[k] if k < len(given) else None
            if v is None:
                if a.default is _REQUIRED:
                    raise SqlError("INVALID_ARGUMENT", f"{self.name} needs {a.name}")
                v = a.default
            out[a.name] = v
        return out

    def signature(self) -> str:
        return f"{self.name}({', '.join(a.name + ('' if a.default is _REQUIRED else f' = {a.default!r}') for a in self.args)})"


def render_call(name: str, values: list) -> str:
    """A call with safe literals."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"{name}({', '.join(map(lit, values))})"


_GLOB = [{"name": n, "type": t} for n, t in (("path", "varchar"), ("file_name", "varchar"), ("size_bytes", "bigint"), ("modified", "timestamptz"))]
_GREP = [{"name": n, "type": t} for n, t in (("path", "varchar"), ("line_number", "bigint"), ("line", "varchar"))]


def _files(base: str, pattern: str) -> list[str]:
    return sorted(p for p in globbing.glob(os.path.join(base, pattern), recursive=True) if os.path.isfile(p))


def file_glob(spark: SparkSession, base: str, pattern: str) -> DataFrame:
    """path, file_name, size_bytes and modified of each matching file, sorted; no match gives no rows."""
    rows = [(p, os.path.basename(p), (s := os.stat(p)).st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc)) for p in _files(base, pattern)]
    return spark.createDataFrame(rows, struct_of(_GLOB))


def file_grep(spark: SparkSession, base: str, pattern: str, glob: str, limit: int | None = None) -> DataFrame:
    """path, line_number and line of each line that the pattern (Java syntax) finds; files that are no UTF-8 are left out; the limit ends it early."""
    files = _files(base, glob)
    if not files:
        return spark.createDataFrame([], struct_of(_GREP))
    whole = spark.read.format("binaryFile").load(files).filter(F.is_valid_utf8(F.col("content").cast("string")))
    lines = whole.select(F.regexp_replace("path", "^file:", "").alias("path"), F.posexplode(F.split(F.regexp_replace(F.col("content").cast("string"), r"\r?\n$", ""), r"\r?\n")).alias("n", "line"))
    df = lines.filter(F.col("line").rlike(pattern)).select("path", (F.col("n") + 1).cast("bigint").alias("line_number"), "line").orderBy("path", "line_number")
    return df.limit(limit) if limit is not None else df


def http_get(spark: SparkSession, url: str, path: str = "$", allowed_hosts: tuple[str, ...] = ()) -> DataFrame:
    """A body row for each match of a JSON path in the response."""
    origin = "/".join(url.split("/")[:3])
    source = {"base_url": origin if origin.split("//")[1].split(":")[0] in allowed_hosts else "http://none.invalid", "allowed_hosts": list(allowed_hosts)}
    _, _, body = request.send(request.build({"name": "get", "path": ""}, origin, {}, {"url": url}), {}, source, request.Limiter(None))
    node = extract.walk(request._json(body), path) if path != "$" else request._json(body)
    rows = node if isinstance(node, list) else [] if node is None else [node]
    return spark.createDataFrame([(extract.text(r),) for r in rows], "body string")


class Registry:
    """The functions of an engine; names are ``namespace.function``."""

    def __init__(self, spark: SparkSession, base: str = ".", allowed_hosts: tuple[str, ...] = ()):
        self.spark, self.functions = spark, {}
        self.add(TableFunction("file.glob", [Argument("pattern")], _GLOB, lambda pattern: file_glob(spark, base, pattern), "files that match a pattern"))
        self.add(TableFunction("file.grep", [Argument("pattern"), Argument("glob"), Argument("limit", "bigint", None)], _GREP, lambda pattern, glob, limit: file_grep(spark, base, pattern, glob, limit), "lines that match a pattern"))
        self.add(TableFunction("http.get", [Argument("url"), Argument("path", "varchar", "$")], [{"name": "body", "type": "json"}], lambda url, path: http_get(spark, url, path, allowed_hosts), "matches in a JSON response"))

    def add(self, f: TableFunction) -> None:
        self.functions[f.name] = f

    def remove(self, namespace: str) -> None:
        self.functions = {n: f for n, f in self.functions.items() if not n.startswith(namespace + ".")}

    def declare_http(self, source: dict, spec: dict) -> None:
        """A declared function over an API: its arguments bind parameters and, with source: arg, come back as columns."""
        args = [Argument(a["name"], a.get("type", "varchar"), a["default"] if "default" in a else None if not a.get("required") else _REQUIRED) for a in spec.get("args", [])]
        returns = [{**c, "source": "param", "param": c.get("arg", c["name"])} if c.get("source") == "arg" else c for c in spec["returns"]]
        table = {**spec, "name": spec["name"], "params": [{"name": a.name, "filterable": False} for a in args], "response": {**spec.get("response", {}), "schema": returns}}

        def run(**bound) -> DataFrame:
            values = {k: v for k, v in bound.items() if v is not None}
            rows = list(request.scan(table, source, values))
            return self.spark.createDataFrame(rows, struct_of(request.columns(table)))

        self.add(TableFunction(f"{source['name']}.{spec['name']}", args, returns, run, spec.get("description", "")))

    def declare_mcp(self, namespace: str, client, spec: dict) -> None:
        from tributary.sources import mcp

        args = [Argument(a["name"], a["type"], _REQUIRED if a.get("required") else None) for a in spec["args"]]

        def run(**bound) -> DataFrame:
            return mcp.fetch(self.spark, client, spec, [(k, "eq", v) for k, v in bound.items() if v is not None])

        self.add(TableFunction(f"{namespace}.{spec['name']}", args, spec["columns"], run, spec.get("description", "")))

    def declare_file(self, namespace: str, source: dict, spec: dict) -> None:
        """A declared function over files: ``path`` with ``{argument}`` in it names them, read as a file source reads them; arguments with ``column`` filter the
        rows by equality, and those of ``returns`` with source: arg come back as columns."""
        from tributary.sources import file as fs

        args = [Argument(a["name"], a.get("type", "varchar"), a["default"] if "default" in a else None if not a.get("required") else _REQUIRED) for a in spec.get("args", [])]
        returns = spec.get("returns", [])

        def run(**bound) -> DataFrame:
            path = re.sub(r"\{(\w+)\}", lambda m: str(bound[m[1]]).replace("..", ""), spec.get("path", source.get("path", "")))
            schema = [c for c in returns if c.get("source") != "arg"]
            df = fs.read_table(self.spark, path, {**source, **spec, **({"schema": schema} if schema else {})})
            for a in spec.get("args", []):
                if a.get("column") and bound[a["name"]] is not None:
                    df = df.filter(F.col(f"`{a['column']}`") == F.lit(bound[a["name"]]))
            return df.withColumns({c["name"]: F.lit(bound[c.get("arg", c["name"])]).cast(spark_type(c.get("type", "varchar"))) for c in returns if c.get("source") == "arg"})

        self.add(TableFunction(f"{namespace}.{spec['name']}", args, returns, run, spec.get("description", "")))

    def call(self, namespace: str, function: str, given: list) -> DataFrame:
        f = self.functions[f"{namespace}.{function}"]
        return f.run(**f.bind(given))
