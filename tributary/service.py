"""The engine: sources as databases, free SQL, semantic queries, snapshots, functions, and the catalog's own tables."""

from __future__ import annotations

import os
import re
import time
import uuid
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import config as cfg
from tributary import storage
from tributary import store as st
from tributary.errors import EngineError
from tributary.functions import scalar
from tributary.functions.macros import MACROS
from tributary.functions.table import Registry
from tributary.plans import sqltext
from tributary.semantic.compiler import Compiler
from tributary.semantic.model import Catalog, Query
from tributary.session import configure
from tributary.sources import file as file_source
from tributary.sources import mcp
from tributary.sources import registry
from tributary.sources.http import table as http
from tributary.streaming.refresh import Refresher

#: Most rows that a bounded query returns, and the default.
MAX_LIMIT, DEFAULT_LIMIT = 100_000, 1_000
#: Queries that the activity log remembers; what is to stay is saved.
ACTIVITY = 10_000


def encode(name: str) -> str:
    """A namespace or source name as a database name: what Spark doesn't take is written as _xx_."""
    return re.sub(r"[^A-Za-z0-9_]", lambda m: f"_{ord(m[0]):x}_", name)


@dataclass
class Handle:
    """A started query: its rows as a DataFrame, and an id by which it can be cancelled."""

    id: str
    df: DataFrame
    spark: SparkSession = field(repr=False)

    @contextmanager
    def tagged(self) -> Iterator[DataFrame]:
        """The rows, for any action: what runs inside, writes too, is stopped when the query is cancelled."""
        self.spark.addTag(self.id)
        try:
            yield self.df
        finally:
            self.spark.removeTag(self.id)

    def collect(self) -> list:
        with self.tagged() as df:
            return df.collect()

    def rows(self) -> Iterator:
        with self.tagged() as df:
            yield from df.toLocalIterator(prefetchPartitions=True)


class Engine:
    def __init__(self, spark: SparkSession, config: dict | None = None, root: str | None = None, namespace: str = "default", redact: str = "literals"):
        self.spark, self.config = configure(spark), cfg.check(config or {})
        self.root = root or storage.qualified(spark, f"{storage.shared_dir(spark)}/tributary-stores/{uuid.uuid4().hex}")
        self.namespace, self.redact = namespace, redact
        self.store = st.Store(spark, self.root, namespace)
        self.functions = Registry(spark, self.config.get("base", "."), tuple(self.config.get("allowed_hosts", ())))
        self.sources: dict[str, dict] = {}
        self.tables: dict[str, dict[str, DataFrame]] = {}
        self.activity: deque[tuple] = deque(maxlen=ACTIVITY)
        self.refreshers: dict[str, list[Refresher]] = {}
        scalar.register(spark)
        self.catalog = Catalog.from_dict(self.config.get("semantic") or {})
        for s in self.config.get("sources", []):
            self.add_source(s)
        self._declare()

    def _declare(self) -> None:
        """The configuration's functions, over http, tool servers or files by the kind of their source."""
        for f in self.config.get("functions", []):
            s = self.sources[f["source"]]
            if s["kind"] == "mcp":
                self.functions.declare_mcp(f["source"], mcp.client_of(s["config"]), f)
            elif s["kind"] == "file":
                self.functions.declare_file(f["source"], s["config"], f)
            else:
                self.functions.declare_http({**s["config"], "name": f["source"]}, f)

    # --- sources -------------------------------------------------------------------------------------------------------------------------------------

    def add_source(self, s: dict) -> list[str]:
        """Register a source; its tables become ``name.table``. A ``cache`` {ttl, refresh, cron} stores each table whole when it is first read, reads the stored
        one as long as ttl says, and fetches it anew every ``refresh`` or when ``cron`` is due."""
        tables = registry.load(self.spark, s["kind"], {**s.get("config", {}), "name": s["name"]})
        for r in self.refreshers.pop(s["name"], []):
            r.stop()
        cache = s.get("cache") or {}
        if cache.get("refresh") or cache.get("cron"):
            every = st.seconds(cache["refresh"]) if cache.get("refresh") else None
            self.refreshers[s["name"]] = [Refresher(lambda: [self.refresh_table(f"{s['name']}.{n}") for n in tables], every, cache.get("cron")).start()]
        db = encode(s["name"])
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
        self.sources[s["name"]], self.tables[s["name"]] = s, tables
        return sorted(tables)

    def remove_source(self, name: str) -> None:
        if name not in self.sources:
            raise EngineError("UNKNOWN_SOURCE", name)
        for r in self.refreshers.pop(name, []):
            r.stop()
        del self.sources[name], self.tables[name]
        self.functions.remove(name)

    def test_source(self, s: dict) -> dict:
        try:
            return {"ok": True, "tables": sorted(registry.load(self.spark, s["kind"], {**s.get("config", {}), "name": s["name"]}))}
        except Exception as e:
            return {"ok": False, "error": str(e)[:500]}

    def refresh_catalog(self, source: str | None = None) -> None:
        """Enumerate globs and infer schemas again."""
        for n in [source] if source else list(self.sources):
            self.add_source(self.sources[n])

    def reload_config(self, config: dict) -> dict[str, list[str]]:
        """Bring the sources to a new configuration; what didn't change is left alone."""
        new = {s["name"]: s for s in cfg.check(config).get("sources", [])}
        diff = {"removed": [n for n in self.sources if n not in new], "added": [n for n in new if n not in self.sources], "changed": [n for n in new if n in self.sources and new[n] != self.sources[n]]}
        for n in diff["removed"]:
            self.remove_source(n)
        for n in diff["added"] + diff["changed"]:
            self.add_source(new[n])
        for f in self.config.get("functions", []):
            self.functions.functions.pop(f"{f['source']}.{f['name']}", None)
        self.config, self.catalog = config, Catalog.from_dict(config.get("semantic") or {})
        self._declare()
        return diff

    def table(self, name: str) -> DataFrame:
        """DataFrame of ``source.table``, ``materialized.t``, ``namespace.source.table``, or a system table."""
        parts = name.split(".")
        if parts[0] in st.namespaces(self.root, self.spark) and len(parts) == 3 and parts[0] not in self.sources:
            s = st.Store(self.spark, self.root, parts[0])
            return s.get(parts[2] if parts[1] == "materialized" else f"{parts[1]}.{parts[2]}")
        if len(parts) == 2:
            a, b = parts
            if a in self.tables and b in self.tables[a]:
                cache = self.sources[a].get("cache")
                return self.store.cached(name, lambda: self.tables[a][b], cache.get("ttl")) if cache else self.tables[a][b]
            if a == "materialized":
                return self.store.get(b)
            if a == "semantic" and b in self.store.entries():
                return self.store.get(b)
            if a == "system":
                return self.system_table(b)
            if a == "information_schema":
                return self.information_schema(b)
        raise EngineError("UNKNOWN_TABLE", f"no table {name!r}")

    # --- SQL -----------------------------------------------------------------------------------------------------------------------------------------

    def query(self, sql: str, params: dict[str, str] | None = None, limit: int | None = None) -> Handle:
        """Plan free SQL; guards are raised here, before anything runs. A limit bounds SELECT and WITH statements only."""
        qid, started, error = f"q-{uuid.uuid4().hex[:12]}", time.time(), None
        try:
            text = sqltext.substitute_params(sql, params)
            name = sqltext.materialize_directive(text)
            df = self._plan(text)
            if name:
                self.materialize(name, df=df, spec={"query": text})
                df = self.store.get(name)
            if limit is not None and re.match(r"(?is)\s*(?:--[^\n]*\n\s*)*(select|with)\b", text):
                df = df.limit(limit)
            return Handle(qid, df, self.spark)
        except Exception as e:
            error = getattr(e, "code", type(e).__name__)
            raise
        finally:
            self.activity.append((qid, "sql", sqltext.redact(sql, self.redact), started, time.time() - started, error, sorted(params or {})))

    def _plan(self, text: str) -> DataFrame:
        made: list[str] = []

        def resolve(call: sqltext.Call) -> str:
            view = f"fn_{uuid.uuid4().hex[:12]}"
            self.functions.call(call.namespace, call.function, call.args).createOrReplaceTempView(view)
            made.append(view)
            return view

        text = sqltext.rewrite_calls(text, set(self.functions.functions), resolve)
        text = sqltext.rewrite_functions(sqltext.rewrite_json_operators(text), MACROS)
        text = sqltext.rewrite_dialect(sqltext.rewrite_or(text))
        text = self._bound(text)
        toks = sqltext.tokens(text)
        out, k = [], 0
        while k < len(toks):
            parts, j = [], k
            while j < len(toks) and toks[j].kind == "ident":
                parts.append(toks[j].name)
                if j + 2 < len(toks) and toks[j + 1].text == "." and toks[j + 2].kind == "ident":
                    j += 2
                else:
                    break
            found = next((n for n in range(min(3, len(parts)), 1, -1) if self._is_table(".".join(parts[:n]))), 0) if not (out and out[-1].text == ".") else 0
            if found:
                name = ".".join(parts[:found])
                view = "t_" + encode(name.replace(".", "__"))
                self.table(name).createOrReplaceTempView(view)
                before = [t for t in out if t.kind not in ("space", "comment")]
                while len(before) > 1 and before[-1].text == "(":  # a join in parentheses
                    before.pop()
                relation = bool(before) and before[-1].text.lower() in ("from", "join", ",")
                nxt = [t for t in toks[k + 2 * found - 1 :] if t.kind not in ("space", "comment")]
                aliased = bool(nxt) and (nxt[0].text.lower() == "as" or nxt[0].kind == "ident" and nxt[0].text.lower() not in _KEYWORDS)
                out.append(sqltext.Token("ident", f"`{view}`" + (f" AS `{parts[found - 1]}`" if relation and not aliased else "")) if relation else sqltext.Token("ident", f"`{parts[found - 1]}`"))
                k += 2 * found - 1
                continue
            out.append(toks[k])
            k += 1
        return self.spark.sql(sqltext.render(out))

    def _required(self, name: str) -> list[str]:
        """Columns of an API table that a query must give."""
        source, _, table = name.partition(".")
        s = self.sources.get(source)
        if not s or s["kind"] != "http" or s.get("cache"):
            return []
        spec = next((t for t in s["config"].get("tables", []) if t["name"] == table), {})
        return [p.get("column", p["name"]) for p in spec.get("params", []) if p.get("required") and "default" not in p]

    def _bound(self, text: str) -> str:
        """Joins with API tables that need a column which the join gives: the distinct keys of the other side, read once, are bound as one IN list."""
        for b in reversed(sqltext.bind_joins(text, self._required)):
            toks = sqltext.tokens(text)
            lead = sqltext.render(toks[: b.start])
            with_ = re.match(r"(?is)\s*(with\b.*?\)\s*)(?=select\b)", lead) if re.match(r"(?is)\s*with\b", lead) else None
            keys = self._plan(f"{with_[1] if with_ else ''}SELECT DISTINCT {b.key} AS k FROM {b.others} WHERE {b.key} IS NOT NULL")
            found = [r[0] for r in keys.limit(http.MAX_KEYS + 1).collect()]
            if len(found) > http.MAX_KEYS:
                raise EngineError("SAFETY_TOO_MANY_ROWS", f"more than {http.MAX_KEYS} keys for {b.name}")
            df = self.table(b.name)
            view = f"bound_{uuid.uuid4().hex[:12]}"
            (df.filter(F.col(f"`{b.column}`").isin(found)) if found else self.spark.createDataFrame([], df.schema)).createOrReplaceTempView(view)
            own = sqltext.render(toks[b.start : b.end])
            alias = re.sub(r"(?is)^[^.]+\.[\w`\"]+\s*(as\s+)?", "", own).strip() or f"`{b.name.split('.')[1]}`"
            text = lead + f"`{view}` AS {alias}" + sqltext.render(toks[b.end :])
        return text

    def _is_table(self, name: str) -> bool:
        parts = name.split(".")
        if len(parts) == 2:
            return parts[1] in self.tables.get(parts[0], {}) or (parts[0] == "materialized" and parts[1] in self.store.entries()) or (parts[0] == "semantic" and parts[1] in self.store.entries()) or (
                parts[0] == "system" and parts[1] in ("activity", "variables")) or (parts[0] == "information_schema" and parts[1] in ("tables", "columns"))
        return len(parts) == 3 and parts[0] in st.namespaces(self.root, self.spark)

    def explain(self, sql: str, params: dict[str, str] | None = None) -> str:
        df = self._plan(sqltext.substitute_params(sql, params))
        return df._jdf.queryExecution().logical().toString() + "\n" + df._jdf.schema().treeString()

    def cancel(self, query_id: str) -> list[str]:
        return self.spark.interruptTag(query_id)

    def bounded(self, sql: str, limit: int = DEFAULT_LIMIT, params: dict[str, str] | None = None) -> tuple[list, bool]:
        """At most ``limit`` rows, and whether there are more."""
        n = max(1, min(limit, MAX_LIMIT))
        rows = self.query(sql, params).df.limit(n + 1).collect()
        return rows[:n], len(rows) > n

    # --- semantic layer ------------------------------------------------------------------------------------------------------------------------------

    def compiler(self) -> Compiler:
        return Compiler(self.catalog, self.table, self._rollup)

    def _rollup(self, model: str, name: str) -> DataFrame | None:
        """The stored roll-up, built on first use and when its refresh time is over; a failure falls back to the base table."""
        key, p = f"{model}__{name}", self.catalog.model(model).pre_aggregations[name]
        try:
            return self.store.cached(key, lambda: Compiler(self.catalog, self.table).rollup_frame(model, name), p.refresh)
        except EngineError:
            return None

    def semantic_query(self, q: Query) -> Handle:
        qid, started, error = f"q-{uuid.uuid4().hex[:12]}", time.time(), None
        try:
            return Handle(qid, self.compiler().compile(q), self.spark)
        except Exception as e:
            error = getattr(e, "code", type(e).__name__)
            raise
        finally:
            self.activity.append((qid, "semantic", ", ".join([*q.measures, *q.dimensions]), started, time.time() - started, error, sorted(q.params)))

    def list_semantic_models(self) -> list[str]:
        return sorted(self.catalog.models)

    def describe_semantic_model(self, name: str) -> dict:
        m = self.catalog.model(name)
        return {"name": m.name, "source": m.source, "description": m.description, "dimensions": sorted(m.dimensions), "measures": sorted(m.measures), "segments": sorted(m.segments), "relationships": [r.name for r in m.relationships]}

    def list_metrics(self) -> list[str]:
        return sorted(self.catalog.metrics)

    def describe_metric(self, name: str) -> dict:
        if name not in self.catalog.metrics:
            raise EngineError("UNKNOWN_METRIC", name)
        m = self.catalog.metrics[name]
        return {"name": m.name, "kind": m.kind, "references": m.references(), "description": m.description}

    # --- snapshots -----------------------------------------------------------------------------------------------------------------------------------

    def materialize(self, name: str, query: str | None = None, path: str | None = None, rows: bytes | None = None, fmt: str = "csv", df: DataFrame | None = None, namespace: str | None = None, spec: dict | None = None) -> dict:
        """Store a query's, file's, URL's or inline result as the pinned table ``materialized.name``, in place of one of that name."""
        s = st.Store(self.spark, self.root, namespace) if namespace else self.store
        if df is None and query is not None:
            df, spec = self._plan(query), {"query": query}
        elif df is None and path is not None:
            df, spec = file_source.read_table(self.spark, path), {"path": path}
        elif df is None and rows is not None:
            at = storage.qualified(self.spark, f"{storage.new_path(self.spark, 'inline')}.{fmt}")
            files = storage.Files(self.spark, at)
            files.write(at, rows)
            try:
                return s.put(name, file_source.read_table(self.spark, at, {"json": {"format": "array" if rows.lstrip()[:1] == b"[" else "ndjson"}}), True, {"inline": fmt})
            finally:
                files.delete(at)
        if df is None:
            raise EngineError("INVALID_ARGUMENT", "materialize needs a query, a path or rows")
        return s.put(name, df, True, spec)

    def refresh_table(self, name: str) -> dict:
        """Run a materialized table's query or file again, or fetch a cached table anew."""
        e = self.store.entries().get(name)
        if not e and name.partition(".")[2] not in self.tables.get(name.partition(".")[0], {}):
            raise EngineError("UNKNOWN_MATERIALIZED", name)
        spec = e["spec"] if e else {}
        if "query" in spec or "path" in spec:
            return self.materialize(name, query=spec.get("query"), path=spec.get("path"))
        source, _, table = name.partition(".")
        if table in self.tables.get(source, {}):
            return self.store.put(name, self.tables[source][table], False, {"kind": "cache"}, (self.sources[source].get("cache") or {}).get("ttl"))
        self.store.drop(name)
        return {}

    def cache_entries(self) -> list[dict]:
        return [{"name": n, "pinned": e["pinned"], "written": e["written"], "fresh": self.store.fresh(n)} for n, e in sorted(self.store.entries().items())]

    def drop_materialized(self, name: str) -> None:
        self.store.drop(name)

    def drop_namespace(self, namespace: str) -> None:
        st.drop_namespace(self.root, namespace, self.spark)

    def invalidate_cache(self, prefix: str = "") -> list[str]:
        return self.store.invalidate(prefix)

    def vacuum_cache(self) -> list[str]:
        return self.store.vacuum()

    # --- catalog -------------------------------------------------------------------------------------------------------------------------------------

    def list_sources(self) -> list[dict]:
        return [{"name": n, "kind": s["kind"], "tables": len(self.tables[n])} for n, s in sorted(self.sources.items())]

    def list_tables(self, source: str | None = None) -> list[str]:
        return sorted(f"{s}.{t}" for s, ts in self.tables.items() if source in (None, s) for t in ts)

    def describe_table(self, name: str) -> dict:
        df = self.table(name)
        s = self.sources.get(name.split(".")[0], {})
        t = next((x for x in s.get("config", {}).get("tables", []) if x.get("name") == name.split(".")[-1]), {})
        return {"name": name, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema], "wiki": [w for w in (s.get("wiki"), t.get("wiki")) if w], "examples": t.get("examples", []), "required_filters": [p.get("column", p["name"]) for p in t.get("params", []) if p.get("required")]}

    def schema_snapshot(self) -> dict[str, list[str]]:
        return {t: [f"{f.name} {f.dataType.simpleString()}" for f in self.table(t).schema] for t in self.list_tables()}

    def list_columns(self, table: str | None = None, source: str | None = None, name: str | None = None, limit: int = 500) -> list[dict]:
        out = [{"table": t, "column": f.name, "type": f.dataType.simpleString()} for t in self.list_tables(source) if table in (None, t) for f in self.table(t).schema if name is None or name.lower() in f.name.lower()]
        return out[:limit]

    def search_tables(self, query: str, source: str | None = None, limit: int = 50) -> list[dict]:
        """Tables in whose name or description every term occurs; a hit in the name scores 10, one only in the description 1."""
        terms, out = query.lower().split(), []
        for t in self.list_tables(source):
            s = self.sources[t.split(".")[0]]
            text = f"{s.get('description', '')} {next((x.get('description', '') for x in s.get('config', {}).get('tables', []) if x.get('name') == t.split('.')[1]), '')}".lower()
            score = 0
            for w in terms:
                score += 10 if w in t.lower() else 1 if w in text else -(10**6)
            if score > 0 or not terms:
                out.append({"table": t, "score": score})
        return sorted(out, key=lambda x: (-x["score"], x["table"]))[:limit]

    def list_functions(self) -> list[str]:
        return sorted(f.signature() for f in self.functions.functions.values())

    def describe_function(self, name: str) -> dict:
        if name not in self.functions.functions:
            raise EngineError("UNKNOWN_FUNCTION", name)
        f = self.functions.functions[name]
        return {"signature": f.signature(), "returns": f.returns, "description": f.description}

    def system_table(self, name: str) -> DataFrame:
        if name == "activity":
            now = self.spark.createDataFrame(list(self.activity), _ACTIVITY)
            saved = (self.config.get("activity") or {}).get("path")
            if not saved or not storage.Files(self.spark, saved).exists(saved):
                return now
            return now.unionByName(self.spark.read.schema(_ACTIVITY + ", dt string, hr string").parquet(saved).drop("dt", "hr"))
        if name == "variables":
            return self.spark.createDataFrame([(v["name"], str(v.get("value")), v.get("description")) for v in self.config.get("variables", [])], "name string, value string, description string")
        raise EngineError("UNKNOWN_TABLE", f"system.{name}")

    def information_schema(self, name: str) -> DataFrame:
        if name == "tables":
            return self.spark.createDataFrame([tuple(t.split(".")) for t in self.list_tables()], "table_schema string, table_name string")
        rows = [(*t.split("."), f.name, k + 1, f.dataType.simpleString()) for t in self.list_tables() for k, f in enumerate(self.table(t).schema)]
        return self.spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string")

    def save_activity(self, path: str | None = None) -> None:
        """Append what the log remembers as Parquet by day and hour, to ``activity: {path}`` of the configuration, which system.activity reads too, or to ``path``."""
        path = path or self.config["activity"]["path"]
        df = self.spark.createDataFrame(list(self.activity), _ACTIVITY).selectExpr("*", "date_format(timestamp_seconds(started), 'yyyy-MM-dd') AS dt", "date_format(timestamp_seconds(started), 'HH') AS hr")
        df.write.mode("append").partitionBy("dt", "hr").parquet(path)
        self.activity.clear()

    def health(self) -> dict:
        return {"ok": not self.spark.sparkContext._jsc.sc().isStopped(), "sources": len(self.sources), "queries": len(self.activity)}

    def shutdown(self) -> None:
        for r in [r for rs in self.refreshers.values() for r in rs]:
            r.stop()
        self.refreshers.clear()


_ACTIVITY = "id string, kind string, text string, started double, seconds double, error string, param_keys array<string>"
_KEYWORDS = set("on using where group order limit join inner left right full cross natural union intersect except having window qualify lateral semi anti offset set tablesample pivot unpivot".split())


def format_rows(df: DataFrame, fmt: str = "table", limit: int = DEFAULT_LIMIT) -> str:
    """Rows as table, json, ndjson or csv text."""
    import csv
    import io
    import json

    rows = df.limit(limit)
    if fmt == "table":
        return rows._jdf.showString(limit, 40, False)
    data = rows.toJSON().collect()
    if fmt == "ndjson":
        return "\n".join(data)
    if fmt == "json":
        return json.dumps([json.loads(x) for x in data])
    if fmt == "csv":
        out = io.StringIO()
        w = csv.writer(out)
        w.writerow(rows.columns)
        w.writerows(rows.collect())
        return out.getvalue()
    raise EngineError("BAD_FORMAT", f"no format {fmt!r}")
