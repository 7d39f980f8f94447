"""The semantic layer over orders, lineitem and customer, each with a hand-written SQL oracle."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.queries.tables import table
from tributary.semantic.compiler import Compiler
from tributary.semantic.model import Catalog, Filter, Query
from tributary.storage import written

CATALOG = Catalog.from_dict({
    "models": [
        {"name": "orders", "source": "t.orders", "dimensions": [{"name": "status", "expr": "o_orderstatus"}, {"name": "priority", "expr": "o_orderpriority"},
            {"name": "day", "expr": "o_orderdate", "type": "time"}, {"name": "price", "expr": "o_totalprice", "type": "number"}],
         "measures": [{"name": "revenue", "agg": "sum", "expr": "o_totalprice"}, {"name": "n", "agg": "count"}, {"name": "customers", "agg": "count_distinct", "expr": "o_custkey"},
            {"name": "urgent", "agg": "sum", "expr": "o_totalprice", "filters": ["o_orderpriority = '1-URGENT'"]}, {"name": "top", "agg": "max", "expr": "o_totalprice"},
            {"name": "spread", "agg": "custom", "expr": "max(o_totalprice) - min(o_totalprice)"}],
         "relationships": [{"name": "customer", "kind": "many_to_one", "target": "customers", "on": "this.o_custkey = customers.c_custkey"},
            {"name": "lines", "kind": "one_to_many", "target": "lines", "on": "this.o_orderkey = lines.l_orderkey"}],
         "segments": [{"name": "open_big", "filters": [{"member": "orders.status", "op": "equals", "values": ["O"]}, {"member": "orders.price", "op": "gt", "values": ["200000"]}]}],
         "pre_aggregations": [{"name": "by_day_status", "dimensions": ["day.day", "status"], "measures": ["revenue", "n", "top"]}]},
        {"name": "customers", "source": "t.customer", "dimensions": [{"name": "segment", "expr": "c_mktsegment"}, {"name": "key", "expr": "c_custkey", "type": "number"}],
         "measures": [{"name": "n", "agg": "count"}],
         "relationships": [{"name": "nation", "kind": "many_to_one", "target": "nations", "on": "this.c_nationkey = nations.n_nationkey"}]},
        {"name": "nations", "source": "t.nation", "dimensions": [{"name": "name", "expr": "n_name"}], "measures": [],
         "relationships": [{"name": "region", "kind": "many_to_one", "target": "regions", "on": "this.n_regionkey = regions.r_regionkey"}]},
        {"name": "regions", "source": "t.region", "dimensions": [{"name": "name", "expr": "r_name"}], "measures": []},
        {"name": "lines", "source": "t.lineitem", "dimensions": [{"name": "flag", "expr": "l_returnflag"}], "measures": [{"name": "qty", "agg": "sum", "expr": "l_quantity"}]},
        {"name": "own_orders", "source": "t.orders", "dimensions": [{"name": "status", "expr": "o_orderstatus"}], "measures": [{"name": "revenue", "agg": "sum", "expr": "o_totalprice"}],
         "safety": {"required_predicates": ["o_orderpriority = ${param:priority}"]}},
    ],
    "metrics": [
        {"name": "aov", "kind": {"ratio": {"numerator": "orders.revenue", "denominator": "orders.n"}}},
        {"name": "urgent_share", "kind": {"ratio": {"numerator": {"member": "orders.revenue", "filter": "o_orderpriority = '1-URGENT'"}, "denominator": "orders.revenue"}}},
        {"name": "calm", "kind": {"derived": {"expr": "{orders.revenue} - {orders.revenue | o_orderpriority = '1-URGENT'}"}}},
        {"name": "running", "kind": {"cumulative": {"measure": "orders.revenue"}}},
        {"name": "ytd", "kind": {"cumulative": {"measure": "orders.revenue", "window": {"grain_to_date": {"grain": "year"}}}}},
        {"name": "last3", "kind": {"cumulative": {"measure": "orders.revenue", "window": {"trailing": {"periods": 3}}, "agg": "avg"}}},
        {"name": "delta", "kind": {"offset": {"measure": "orders.revenue", "output": "delta"}}},
        {"name": "growth", "kind": {"offset": {"measure": "orders.revenue", "output": "growth"}}},
        {"name": "part", "kind": {"share": {"measure": "orders.revenue", "over": ["orders.status"]}}},
    ],
})


def compiler(spark: SparkSession, d: str, rolled: bool = False) -> Compiler:
    c = Compiler(CATALOG, lambda name: table(spark, d, name.split(".")[1]))
    if rolled:
        c.rollup = lambda m, p: written(c.rollup_frame(m, p), "rollup")
    return c


def _case(names: dict[str, str], measures=(), dimensions=(), rolled=False, **more):
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = compiler(spark, d, rolled).compile(Query(list(measures), list(dimensions), **more))
        kinds = dict(df.dtypes)
        return df.select(*[(F.round(F.col(f"`{k}`"), 4) if kinds[k] == "double" else F.col(f"`{k}`")).alias(v) for k, v in names.items()])

    return run


_M = {"orders.day.month": "m"}
QUERIES = {
    "sem_single": _case({"orders.status": "st", "orders.revenue": "rev", "orders.n": "n", "orders.customers": "c", "orders.urgent": "u", "orders.spread": "sp"}, ["orders.revenue", "orders.n", "orders.customers", "orders.urgent", "orders.spread"], ["orders.status"]),
    "sem_grain_month": _case(_M | {"orders.n": "n"}, ["orders.n"], ["orders.day.month"]),
    "sem_grain_zone": _case({"orders.day.day": "d", "orders.n": "n"}, ["orders.n"], ["orders.day.day"], time_zone="America/New_York"),
    "sem_join_region": _case({"regions.name": "r", "orders.revenue": "rev"}, ["orders.revenue"], ["regions.name"]),
    "sem_having": _case({"customers.key": "k", "orders.n": "n"}, ["orders.n"], ["customers.key"], filters=[Filter("orders.n", "gt", ("12",))]),
    "sem_filters": _case({"orders.status": "st", "orders.n": "n"}, ["orders.n"], ["orders.status"], filters=[Filter("orders.priority", "contains", ("HIGH",)), Filter("orders.price", "in_range", ("1000", "300000")), Filter("orders.status", "not_in", ("P",))]),
    "sem_multi_fact": _case({"orders.n": "n", "lines.qty": "q"}, ["orders.n", "lines.qty"], []),
    "sem_multi_fact_dims": _case({"customers.segment": "s", "orders.revenue": "rev", "customers.n": "n"}, ["orders.revenue", "customers.n"], ["customers.segment"]),
    "sem_segment": _case({"orders.priority": "p", "orders.n": "n"}, ["orders.n"], ["orders.priority"], segments=["orders.open_big"]),
    "sem_rls": _case({"own_orders.status": "st", "own_orders.revenue": "rev"}, ["own_orders.revenue"], ["own_orders.status"], params={"priority": "2-HIGH"}),
    "sem_dims_only": _case({"orders.status": "st", "orders.priority": "p"}, [], ["orders.status", "orders.priority"]),
    "sem_top": _case({"customers.key": "k", "orders.revenue": "rev"}, ["orders.revenue"], ["customers.key"], order_by=[("orders.revenue", "desc"), ("customers.key", "asc")], limit=10),
    "metric_ratio": _case({"orders.status": "st", "aov": "aov", "urgent_share": "us"}, ["aov", "urgent_share"], ["orders.status"]),
    "metric_derived": _case({"orders.status": "st", "calm": "calm"}, ["calm"], ["orders.status"]),
    "metric_running": _case(_M | {"running": "v"}, ["running"], ["orders.day.month"]),
    "metric_ytd": _case(_M | {"orders.status": "st", "ytd": "v"}, ["ytd"], ["orders.day.month", "orders.status"]),
    "metric_trailing": _case(_M | {"last3": "v"}, ["last3"], ["orders.day.month"]),
    "metric_offset": _case(_M | {"delta": "v", "growth": "g"}, ["delta", "growth"], ["orders.day.month"]),
    "metric_share": _case({"orders.status": "st", "orders.priority": "p", "part": "v"}, ["part"], ["orders.status", "orders.priority"]),
    "rollup_reagg": _case(_M | {"orders.revenue": "rev", "orders.n": "n", "orders.top": "t"}, ["orders.revenue", "orders.n", "orders.top"], ["orders.day.month"], rolled=True, filters=[Filter("orders.status", "equals", ("F",))]),
}
_MONTHS = "a AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS x FROM orders GROUP BY 1), ax AS (SELECT CAST(unnest(generate_series((SELECT min(m) FROM a), (SELECT max(m) FROM a), INTERVAL '1 month')) AS TIMESTAMP) AS m), s AS (SELECT ax.m, coalesce(x, 0) AS x FROM ax LEFT JOIN a ON ax.m = a.m)"
_BASE = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
ORACLE = {
    "sem_single": "SELECT o_orderstatus AS st, round(sum(o_totalprice), 4) AS rev, count(*) AS n, count(DISTINCT o_custkey) AS c, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 4) AS u, round(max(o_totalprice) - min(o_totalprice), 4) AS sp FROM orders GROUP BY 1",
    "sem_grain_month": "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n FROM orders GROUP BY 1",
    "sem_grain_zone": "SELECT CAST(date_trunc('day', CASE WHEN month(o_orderdate) BETWEEN 4 AND 10 THEN o_orderdate - INTERVAL '4 hours' ELSE o_orderdate - INTERVAL '5 hours' END) AS TIMESTAMP) AS d, count(*) AS n FROM orders GROUP BY 1",
    "sem_join_region": f"SELECT r_name AS r, round(sum(o_totalprice), 4) AS rev FROM {_BASE} GROUP BY 1",
    "sem_having": f"SELECT c_custkey AS k, count(*) AS n FROM {_BASE} GROUP BY 1 HAVING count(*) > 12",
    "sem_filters": "SELECT o_orderstatus AS st, count(*) AS n FROM orders WHERE o_orderpriority LIKE '%HIGH%' AND o_totalprice BETWEEN 1000 AND 300000 AND o_orderstatus <> 'P' GROUP BY 1",
    "sem_multi_fact": "SELECT (SELECT count(*) FROM orders) AS n, (SELECT round(sum(l_quantity), 4) FROM lineitem) AS q",
    "sem_multi_fact_dims": "SELECT s, rev, n FROM (SELECT c_mktsegment AS s, round(sum(o_totalprice), 4) AS rev FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) FULL JOIN (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1) USING (s)",
    "sem_segment": "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000 GROUP BY 1",
    "sem_rls": "SELECT o_orderstatus AS st, round(sum(o_totalprice), 4) AS rev FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1",
    "sem_dims_only": "SELECT DISTINCT o_orderstatus AS st, o_orderpriority AS p FROM orders",
    "sem_top": f"SELECT c_custkey AS k, round(sum(o_totalprice), 4) AS rev FROM {_BASE} GROUP BY 1 ORDER BY rev DESC, k LIMIT 10",
    "metric_ratio": "SELECT o_orderstatus AS st, round(sum(o_totalprice) / count(*), 4) AS aov, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') / sum(o_totalprice), 4) AS us FROM orders GROUP BY 1",
    "metric_derived": "SELECT o_orderstatus AS st, round(sum(o_totalprice) - sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 4) AS calm FROM orders GROUP BY 1",
    "metric_running": f"WITH {_MONTHS} SELECT m, round(sum(x) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING), 4) AS v FROM s",
    "metric_ytd": """WITH a AS (SELECT date_trunc('month', o_orderdate) AS m, o_orderstatus AS st, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2),
        ax AS (SELECT CAST(unnest(generate_series((SELECT min(m) FROM a), (SELECT max(m) FROM a), INTERVAL '1 month')) AS TIMESTAMP) AS m), k AS (SELECT DISTINCT st FROM a),
        s AS (SELECT ax.m, k.st, coalesce(x, 0) AS x FROM ax CROSS JOIN k LEFT JOIN a ON a.m = ax.m AND a.st = k.st)
        SELECT m, st, round(sum(x) OVER (PARTITION BY st, date_trunc('year', m) ORDER BY m ROWS UNBOUNDED PRECEDING), 4) AS v FROM s""",
    "metric_trailing": f"WITH {_MONTHS} SELECT m, round(avg(x) OVER (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS v FROM s",
    "metric_offset": f"WITH {_MONTHS} SELECT m, round(x - lag(x) OVER (ORDER BY m), 4) AS v, round((x - lag(x) OVER (ORDER BY m)) / nullif(lag(x) OVER (ORDER BY m), 0), 4) AS g FROM s",
    "metric_share": "WITH a AS (SELECT o_orderstatus AS st, o_orderpriority AS p, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2) SELECT st, p, round(x / nullif(sum(x) OVER (PARTITION BY st), 0), 4) AS v FROM a",
    "rollup_reagg": "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, round(sum(o_totalprice), 4) AS rev, count(*) AS n, round(max(o_totalprice), 4) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
}
