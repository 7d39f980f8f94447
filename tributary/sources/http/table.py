"""HTTP tables as Spark data sources: filters go into the request, every parameter set is a partition."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tributary.errors import EngineError
from tributary.sources.http import request
from tributary.sources.types import struct_of

_OPS = {EqualTo: "eq", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}
#: Most keys of a dependent join, each being a request.
MAX_KEYS = 100_000
RAW_SCHEMA = [{"name": n, "type": t} for n, t in (("request_method", "varchar"), ("request_path", "varchar"), ("request_query", "varchar"), ("response_status", "int"), ("response_body", "varchar"))]


class ParamSet(InputPartition):
    def __init__(self, bound: dict):
        super().__init__(json.dumps(bound, default=str))


class HttpReader(DataSourceReader):
    def __init__(self, source: dict, spec: dict, limit: int | None):
        self.source, self.spec, self.limit, self.filters = source, spec, limit, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        bindable = {p.get("column", p["name"]): p for p in self.spec.get("params", [])}
        for f in filters:
            op, name = _OPS.get(type(f)), f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            p = bindable.get(name)
            if op and p and (op in ("eq", "in") or op in p.get("accepts", {})):
                self.filters.append((name, op, list(f.value) if op == "in" else f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.spec.get("raw"):
            given = {c: (list(v) if op == "in" else [v]) for c, op, v in self.filters}
            if "request_path" not in given:
                raise EngineError("SAFETY_REQUIRED_FILTER", f"{self.spec['name']} needs a filter on request_path")
            return [ParamSet({"path": p, "query": q, "method": m}) for p in given["request_path"] for q in given.get("request_query", [""]) for m in given.get("request_method", ["GET"])]
        return [ParamSet(b) for b in request.bind(self.spec, self.filters)[0]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        bound = json.loads(partition.value)
        if self.spec.get("raw"):
            yield raw_row(self.source, bound)
        else:
            yield from request.scan(self.spec, self.source, bound, self.limit)


def raw_row(source: dict, bound: dict) -> tuple:
    """One request and its response as they are; error statuses are rows too."""
    path, query = bound["path"], bound.get("query") or ""
    spec = {"name": "raw", "path": path + (f"?{query}" if query else ""), "method": bound.get("method") or "GET", "headers": source.get("headers", {})}
    status, _, body = request.send(request.build(spec, source["base_url"], {}, {}), spec, source, request.Limiter(None))
    return spec["method"], path, query, status, body


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tributary_http"

    def schema(self):
        return struct_of(request.columns(json.loads(self.options["spec"])))

    def reader(self, schema) -> HttpReader:
        limit = self.options.get("limit")
        return HttpReader(json.loads(self.options["source"]), json.loads(self.options["spec"]), int(limit) if limit else None)


def raw_spec(name: str) -> dict:
    return {"name": name, "raw": True, "response": {"schema": RAW_SCHEMA}, "params": [{"name": c, "column": c} for c in ("request_path", "request_query", "request_method")], "path": ""}


def read_table(spark: SparkSession, source: dict, spec: dict, limit: int | None = None) -> DataFrame:
    spark.dataSource.register(HttpSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("tributary_http").option("source", json.dumps(source)).option("spec", json.dumps(spec))
    return (r.option("limit", limit) if limit is not None else r).load()


def fetch(spark: SparkSession, source: dict, spec: dict, filters: list[tuple[str, str, object]], limit: int | None = None) -> DataFrame:
    """Rows for the given filters, fetched now; errors of binding, pages and rows are raised here and not later. The filters that don't bind are applied."""
    sets, rest = request.bind(spec, filters)
    rows = []
    for b in sets:
        rows += request.scan(spec, source, b, None if rest or limit is None else limit - len(rows))
        if limit is not None and not rest and len(rows) >= limit:
            break
    df = spark.createDataFrame(rows, struct_of(request.columns(spec)))
    ops = {"eq": "__eq__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
    for c, op, v in rest:
        df = df.filter(F.col(c).isin(list(v)) if op == "in" else getattr(F.col(c), ops[op])(v))
    return df.limit(limit) if limit is not None else df


def dependent_join(driver: DataFrame, key: str, source: dict, spec: dict, param_column: str, cap: int | None = None, max_keys: int = MAX_KEYS) -> DataFrame:
    """``driver`` joined with an API table whose required ``param_column`` comes from ``key``: the distinct non-null keys are bound as one IN list.

    ``cap`` is a LIMIT that holds for the driver's rows before any sort or aggregate; it bounds the keys that are asked for. More than ``max_keys`` keys are
    refused, since each is a request.
    """
    rows = driver.limit(cap) if cap is not None else driver
    keys = [r[0] for r in rows.select(key).filter(F.col(key).isNotNull()).distinct().limit(max_keys + 1).collect()]
    if len(keys) > max_keys:
        raise EngineError("SAFETY_TOO_MANY_ROWS", f"more than {max_keys} keys for {spec['name']}")
    spark = driver.sparkSession
    if not keys:
        return rows.join(spark.createDataFrame([], struct_of(request.columns(spec))).withColumnRenamed(param_column, "__probe"), F.lit(False), "inner").drop("__probe")
    probe = read_table(spark, source, spec).filter(F.col(param_column).isin(keys)).withColumnRenamed(param_column, "__probe")
    return rows.join(probe, F.col(key).cast("string") == F.col("__probe").cast("string")).drop("__probe")


def tables(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Declared tables, those of an OpenAPI document patched by equal names, and the raw table under the source's own name."""
    from tributary.sources.http.openapi import merge, synthesize

    if urlsplit(config["base_url"]).scheme not in ("http", "https"):
        raise EngineError("CONFIG_SOURCE", "base_url must be an http address")
    specs = {t["name"]: t for t in synthesize(config["openapi"])} if config.get("openapi") else {}
    for t in config.get("tables", []):
        specs[t["name"]] = merge(specs[t["name"]], t) if t["name"] in specs else t
    out = {n: read_table(spark, config, s) for n, s in specs.items()}
    if config.get("raw", not specs):
        out[config.get("name", "raw")] = read_table(spark, config, raw_spec(config.get("name", "raw")))
    return out
