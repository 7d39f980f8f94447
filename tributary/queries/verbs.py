"""What the engine says about itself and its queries: catalog, activity, limits, snapshots, formats, checks of the semantic layer."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.plans import sqltext
from tributary.queries.relational import engine
from tributary.queries.semantic import CATALOG, compiler
from tributary.queries.tables import table
from tributary.semantic.model import Catalog, Query
from tributary.service import Engine, format_rows
from tributary.storage import new_path, qualified
from tributary.streaming.refresh import Cron


def _fresh(spark: SparkSession, d: str, **more) -> Engine:
    files = [{"name": t, "path": f"{d}/{t}.parquet", "format": "parquet", "description": f"the {t} of the shop"} for t in ("nation", "region", "orders", "customer")]
    return Engine(spark, {"sources": [{"name": "t", "kind": "file", "description": "test tables", "config": {"tables": files}, "wiki": "about"}], **more})


def _code(call, *args) -> str:
    try:
        call(*args)
        return "fine"
    except Exception as e:
        return getattr(e, "code", type(e).__name__)


def sys_columns(spark: SparkSession, d: str) -> DataFrame:
    return _fresh(spark, d).query("SELECT c.table_name, c.column_name, c.ordinal_position, c.data_type FROM information_schema.columns c JOIN information_schema.tables t ON c.table_name = t.table_name WHERE c.table_name IN ('nation', 'region')").df


def sys_activity(spark: SparkSession, d: str) -> DataFrame:
    e = _fresh(spark, d, variables=[{"name": "v", "value": 7, "description": "a variable"}])
    e.query("SELECT n_name FROM t.nation WHERE n_name = 'secret' AND n_nationkey > 5").collect()
    _code(e.query, "SELECT * FROM t.nothing")
    return e.query("SELECT a.text, a.error IS NULL AS fine, v.value FROM system.activity a CROSS JOIN system.variables v").df


def sys_durable_activity(spark: SparkSession, d: str) -> DataFrame:
    """Saved and remembered queries together, as another engine would read them too."""
    e = _fresh(spark, d, activity={"path": qualified(spark, new_path(spark, "activity"))})
    for k in range(3):
        e.query(f"SELECT {k} AS k").collect()
        e.save_activity()
    e.query("SELECT 3 AS k").collect()
    return e.query("SELECT text, count(*) AS n, CAST(count(DISTINCT id) AS INT) AS ids FROM system.activity WHERE kind = 'sql' GROUP BY text").df


def verb_catalog(spark: SparkSession, d: str) -> DataFrame:
    e = _fresh(spark, d)
    out = [("search", json.dumps([(x["table"], x["score"]) for x in e.search_tables("nation")])), ("by_description", json.dumps([(x["table"], x["score"]) for x in e.search_tables("shop orders")])), ("nothing", json.dumps(e.search_tables("nowhere"))),
           ("columns", json.dumps(sorted(c["column"] for c in e.list_columns(name="regionkey")))), ("describe", json.dumps([c["name"] for c in e.describe_table("t.region")["columns"]] + e.describe_table("t.region")["wiki"])), ("sources", json.dumps([(s["name"], s["kind"], s["tables"]) for s in e.list_sources()])),
           ("reload", json.dumps(e.reload_config({**e.config, "sources": []}))), ("gone", _code(e.table, "t.nation"))]
    return spark.createDataFrame(out, "verb string, answer string")


def verb_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Limits: a bounded query says whether there is more; a statement's limit holds besides its own."""
    e = engine(spark, d)
    rows, more = e.bounded("SELECT n_nationkey FROM t.nation ORDER BY n_nationkey", 10)
    all_rows, no_more = e.bounded("SELECT n_nationkey FROM t.nation", 1000)
    capped = e.query("SELECT n_nationkey FROM t.nation", limit=3).df.count()
    return spark.createDataFrame([(len(rows), more, len(all_rows), no_more, capped)], "n int, more boolean, n_all int, no_more boolean, capped int")


def verb_explain(spark: SparkSession, d: str) -> DataFrame:
    text = engine(spark, d).explain("SELECT n_name FROM t.nation WHERE n_nationkey > ${param:k}", {"k": "3"})
    return spark.createDataFrame([("Filter" in text, "n_name" in text, "Exchange" in text)], "filter boolean, column_name boolean, physical boolean")


def verb_formats(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "region").orderBy("r_regionkey").limit(2)
    return spark.createDataFrame([(f, format_rows(df, f).strip().replace("\r\n", "\n")) for f in ("json", "ndjson", "csv")], "format string, text string")


def verb_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The life of stored tables: made from a query, a file and rows, refreshed, dropped, vacuumed, and refused when unknown."""
    e, out = _fresh(spark, d), []
    e.materialize("q", query="SELECT count(*) AS n FROM t.nation")
    e.materialize("f", path=f"{d}/region.parquet")
    e.materialize("r", rows=b"a,b\n1,x\n2,y\n", fmt="csv")
    out.append(("counts", ",".join(str(e.query(f"SELECT * FROM materialized.{x}").df.count()) for x in "qfr")))
    e.refresh_table("q")
    e.drop_materialized("f")
    out += [("names", ",".join(x["name"] for x in e.cache_entries())), ("dropped", _code(e.query, "SELECT * FROM materialized.f")), ("unknown", _code(e.drop_materialized, "zz")), ("bad_name", _code(e.materialize, "../x", "SELECT 1")), ("vacuum", str(len(e.vacuum_cache()))), ("invalidated", ",".join(e.invalidate_cache()))]
    return spark.createDataFrame(out, "step string, answer string")


def verb_redact(spark: SparkSession, d: str) -> DataFrame:
    sql = "SELECT n_name FROM t.nation WHERE n_name = 'x' AND n_nationkey > 5"
    return spark.createDataFrame([(m, sqltext.redact(sql, m)) for m in ("off", "literals", "shape")], "mode string, text string")


def verb_cancel(spark: SparkSession, d: str) -> DataFrame:
    """A cancelled query's jobs are told to stop, by its own id only; a finished one has none left."""
    h = engine(spark, d).query("SELECT count(*) AS n FROM t.nation")
    n = h.collect()[0][0]
    return spark.createDataFrame([(n, len(engine(spark, d).cancel(h.id)), len(engine(spark, d).cancel(f"q-{uuid.uuid4().hex}")))], "n long, jobs int, unknown int")


def verb_cron(spark: SparkSession, d: str) -> DataFrame:
    lines = [("*/15 8-9 * * *", "2024-01-01 09:50"), ("0 0 1 * 1", "2024-05-02 00:00"), ("5 4 29 2 *", "2024-03-01 00:00"), ("30 6 * * 1-5", "2024-01-05 07:00")]
    return spark.createDataFrame([(x, Cron(x).next(datetime.fromisoformat(t)).isoformat(" ", "minutes")) for x, t in lines], "line string, due string")


def sem_errors(spark: SparkSession, d: str) -> DataFrame:
    c = compiler(spark, d)
    cases = {
        "model": Query(["nope.x"]), "member": Query(["orders.nope"]), "metric": Query(["nope"]), "segment": Query(["orders.n"], segments=["orders.nope"]), "empty": Query(), "fan_out": Query(["orders.revenue"], ["lines.flag"]), "grain": Query(["orders.n"], ["orders.day.minute"]),
        "needs_time": Query(["running"], ["orders.status"]), "share": Query(["part"], ["orders.priority"]), "unbound": Query(["own_orders.revenue"], ["own_orders.status"]), "disconnected": Query(["own_orders.revenue"], ["regions.name"], params={"priority": "x"}), "fine": Query(["orders.n"]),
    }
    out = [(n, _code(c.compile, q)) for n, q in cases.items()]
    loop = {"metrics": [{"name": "a", "kind": {"derived": {"expr": "{b}"}}}, {"name": "b", "kind": {"derived": {"expr": "{a}"}}}]}
    out.append(("cycle", _code(Catalog.from_dict, loop)))
    guarded = Catalog.from_dict({"models": [{"name": "o", "source": "t.orders", "dimensions": [{"name": "s", "expr": "o_orderstatus"}], "measures": [{"name": "n", "agg": "count"}], "safety": {"require_filters_on": ["s"]}}]})
    c.catalog = guarded
    out.append(("required_filter", _code(c.compile, Query(["o.n"]))))
    return spark.createDataFrame(out, "case_name string, code string")


def sem_listing(spark: SparkSession, d: str) -> DataFrame:
    e = _fresh(spark, d)
    e.catalog = CATALOG
    m = e.describe_semantic_model("customers")
    out = [("models", ",".join(e.list_semantic_models())), ("metrics", ",".join(e.list_metrics())), ("dimensions", ",".join(m["dimensions"])), ("relationships", ",".join(m["relationships"])), ("metric", ",".join(e.describe_metric("aov")["references"])), ("unknown", _code(e.describe_metric, "nope"))]
    return spark.createDataFrame(out, "what string, answer string")


def sem_row_cap(spark: SparkSession, d: str) -> DataFrame:
    """A model's row cap is the default limit and the most that a query's own limit can ask for."""
    c = compiler(spark, d)
    c.catalog = Catalog.from_dict({"models": [{"name": "n", "source": "t.nation", "dimensions": [{"name": "k", "expr": "n_nationkey", "type": "number"}], "measures": [{"name": "c", "agg": "count"}], "safety": {"max_rows": 7}}]})
    counts = [c.compile(Query(["n.c"], ["n.k"], limit=x)).count() for x in (None, 3, 100)]
    return spark.createDataFrame([tuple(counts)], "by_default long, small long, big long")


def metric_over_metric(spark: SparkSession, d: str) -> DataFrame:
    """A metric of metrics, and one whose measure a roll-up gives."""
    spec = {"models": [{"name": "o", "source": "t.orders", "dimensions": [{"name": "s", "expr": "o_orderstatus"}, {"name": "p", "expr": "o_orderpriority"}], "measures": [{"name": "rev", "agg": "sum", "expr": "o_totalprice"}, {"name": "n", "agg": "count"}],
                        "pre_aggregations": [{"name": "by", "dimensions": ["s", "p"], "measures": ["rev", "n"]}]}],
            "metrics": [{"name": "aov", "kind": {"ratio": {"numerator": "o.rev", "denominator": "o.n"}}}, {"name": "twice", "kind": {"derived": {"expr": "{aov} * 2"}}}]}
    e = _fresh(spark, d, semantic=spec)
    out = e.semantic_query(Query(["twice", "aov"], ["o.s"])).df
    assert "o__by" in e.store.entries()  # the metric was read from the stored roll-up
    return out.select(F.col("`o.s`").alias("s"), F.round("twice", 4).alias("twice"), F.round("aov", 4).alias("aov"))


QUERIES = {f.__name__: f for f in (sys_columns, sys_activity, sys_durable_activity, verb_catalog, verb_bounded, verb_explain, verb_formats, verb_snapshots, verb_redact, verb_cancel, verb_cron, sem_errors, sem_listing, sem_row_cap, metric_over_metric)}


def _values(names: str, rows: list[tuple[str, str]]) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, b in rows)}) t({names})"


ORACLE = {
    "sys_columns": "SELECT table_name, column_name, CAST(k AS INTEGER) AS ordinal_position, data_type FROM (VALUES ('nation', 'n_nationkey', 1, 'int'), ('nation', 'n_name', 2, 'string'), ('nation', 'n_regionkey', 3, 'int'), ('region', 'r_regionkey', 1, 'int'), ('region', 'r_name', 2, 'string')) t(table_name, column_name, k, data_type)",
    "sys_activity": "SELECT * FROM (VALUES ('SELECT n_name FROM t.nation WHERE n_name = ''?'' AND n_nationkey > ?', true, '7'), ('SELECT * FROM t.nothing', false, '7')) t(text, fine, value)",
    "sys_durable_activity": "SELECT 'SELECT ? AS k' AS text, CAST(4 AS BIGINT) AS n, 4 AS ids",
    "verb_catalog": _values("verb, answer", [("search", '[["t.nation", 10]]'), ("by_description", '[["t.orders", 11]]'), ("nothing", "[]"), ("columns", '["n_regionkey", "r_regionkey"]'), ("describe", '["r_regionkey", "r_name", "about"]'), ("sources", '[["t", "file", 4]]'), ("reload", '{"removed": ["t"], "added": [], "changed": []}'), ("gone", "UNKNOWN_TABLE")]),
    "verb_bounded": "SELECT 10 AS n, true AS more, CAST(count(*) AS INTEGER) AS n_all, false AS no_more, 3 AS capped FROM nation",
    "verb_explain": "SELECT true AS filter, true AS column_name, false AS physical",
    "verb_formats": "WITH r AS (SELECT * FROM region ORDER BY r_regionkey LIMIT 2) SELECT 'json' AS format, '[' || string_agg('{\"r_regionkey\": ' || r_regionkey || ', \"r_name\": \"' || r_name || '\"}', ', ' ORDER BY r_regionkey) || ']' AS text FROM r UNION ALL SELECT 'ndjson', string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', chr(10) ORDER BY r_regionkey) FROM r UNION ALL SELECT 'csv', 'r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name, chr(10) ORDER BY r_regionkey) FROM r",
    "verb_snapshots": "SELECT 'counts' AS step, '1,' || (SELECT count(*) FROM region) || ',2' AS answer UNION ALL " + _values("step, answer", [("names", "q,r"), ("dropped", "AnalysisException"), ("unknown", "UNKNOWN_MATERIALIZED"), ("bad_name", "INVALID_NAME"), ("vacuum", "0"), ("invalidated", "")]),
    "verb_redact": _values("mode, text", [("off", "SELECT n_name FROM t.nation WHERE n_name = 'x' AND n_nationkey > 5"), ("literals", "SELECT n_name FROM t.nation WHERE n_name = '?' AND n_nationkey > ?"), ("shape", "SELECT t.nation")]),
    "verb_cancel": "SELECT count(*) AS n, 0 AS jobs, 0 AS unknown FROM nation",
    "verb_cron": _values("line, due", [("*/15 8-9 * * *", "2024-01-02 08:00"), ("0 0 1 * 1", "2024-05-06 00:00"), ("5 4 29 2 *", "2028-02-29 04:05"), ("30 6 * * 1-5", "2024-01-08 06:30")]),
    "sem_errors": _values("case_name, code", [("model", "UNKNOWN_MODEL"), ("member", "UNKNOWN_MEMBER"), ("metric", "UNKNOWN_METRIC"), ("segment", "UNKNOWN_SEGMENT"), ("empty", "EMPTY_QUERY"), ("fan_out", "FAN_OUT"), ("grain", "INVALID_GRAIN"), ("needs_time", "METRIC_NEEDS_TIME"), ("share", "SHARE_DIM"), ("unbound", "SAFETY_UNBOUND_PARAM"), ("disconnected", "DISCONNECTED"), ("fine", "fine"), ("cycle", "METRIC_CYCLE"), ("required_filter", "SAFETY_REQUIRED_FILTER")]),
    "sem_listing": _values("what, answer", [("models", "customers,lines,nations,orders,own_orders,regions"), ("metrics", "aov,calm,delta,growth,last3,part,running,urgent_share,ytd"), ("dimensions", "key,segment"), ("relationships", "nation"), ("metric", "orders.revenue,orders.n"), ("unknown", "UNKNOWN_METRIC")]),
    "sem_row_cap": "SELECT CAST(7 AS BIGINT) AS by_default, CAST(3 AS BIGINT) AS small, CAST(7 AS BIGINT) AS big",
    "metric_over_metric": "SELECT o_orderstatus AS s, round(sum(o_totalprice) / count(*) * 2, 4) AS twice, round(sum(o_totalprice) / count(*), 4) AS aov FROM orders GROUP BY 1",
}
