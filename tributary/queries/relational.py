"""Relational operators, aggregates, windows, set operations and subqueries, as SQL over the test tables; text that both dialects share is given once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.plans import sqltext
from tributary.service import Engine
from tributary.storage import Files

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings shop_orders customers order_items sales feeds eval_items".split())


_engines: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, d: str) -> Engine:
    """An engine over the test tables of ``d`` as source t, one per application and folder, as a service keeps its sources open."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _engines:
        there = Files(spark, d)
        files = [{"name": t, "path": f"{d}/{t}.parquet", "format": "parquet"} for t in sorted(TABLES) if there.exists(f"{d}/{t}.parquet")]
        _engines[key] = Engine(spark, {"sources": [{"name": "t", "kind": "file", "config": {"tables": files}}]})
    return _engines[key]


def run_sql(spark: SparkSession, d: str, sql: str, params: dict[str, str] | None = None) -> DataFrame:
    """``sql`` by the engine, with the tables that its FROM clauses name taken from source t."""
    toks = sqltext.tokens(sql)
    for i, t in enumerate(toks):
        if t.kind == "ident" and t.text in TABLES and sqltext._in_from(toks, i):
            before = next(x.text.lower() for x in reversed(toks[:i]) if x.kind not in ("space", "comment"))
            if before in ("from", "join", ","):
                t.text = f"t.{t.text}"
    return engine(spark, d).query(sqltext.render(toks), params).df


#: name: SQL of both, or (Spark SQL, DuckDB SQL)
SQL: dict[str, str | tuple[str, str]] = {
    # projection and predicates
    "proj_arith": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity + 1 AS q1, -l_tax AS neg_tax FROM lineitem",
    "filter_and_or": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR NOT (o_orderpriority <> '1-URGENT')",
    "between_like": "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand LIKE 'Brand#1%' AND p_type NOT LIKE '%SMALL%'",
    "in_list": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "null_predicates": "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS st FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL AND nullif(o_orderpriority, 'x') IS NOT NULL",
    "null_safe_equal": "SELECT count(*) AS n FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey AND nullif(a.o_orderstatus, 'P') IS NOT DISTINCT FROM nullif(b.o_orderstatus, 'P')",
    "like_wildcards": "SELECT c_custkey FROM customer WHERE c_name LIKE '%00_1%'",
    "values_relation": "SELECT v.k, v.x FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(k, x)",
    "substring_extract": "SELECT o_orderkey, substring(o_orderpriority FROM 3 FOR 4) AS pr, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m FROM orders",
    # joins
    "join_inner": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 150000",
    "join_left_residual": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'",
    "join_right": "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "join_full_nullsafe": """WITH a AS (SELECT nullif(o_orderstatus, 'P') AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT nullif(l_linestatus, 'O') AS k, count(*) AS m FROM lineitem GROUP BY 1)
        SELECT coalesce(a.k, b.k) AS k, n, m FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k""",
    "join_cross": "SELECT r_name, n_nationkey FROM region CROSS JOIN nation",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "join_semi_in": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_notin_nullaware": "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)",
    "join_left_semi_syntax": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_left_anti_syntax": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_self": "SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1, nation n2 WHERE n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey <> n2.n_nationkey",
    "join_using": "SELECT k, a.n, b.m FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) a JOIN (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY s_nationkey) b USING (k)",
    "join_natural": "SELECT k, n, m FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) a NATURAL JOIN (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY s_nationkey) b",
    "join_comma": "SELECT s_name, n_name, r_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    "join_lateral": "SELECT r_name, t.top FROM region, LATERAL (SELECT max(n_nationkey) AS top FROM nation WHERE n_regionkey = r_regionkey) t",
    # aggregation
    "agg_basic": "SELECT l_returnflag, round(sum(l_quantity), 2) AS s, count(*) AS n, count(nullif(l_linestatus, 'O')) AS nf, round(avg(l_discount), 6) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag",
    "agg_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus",
    "agg_filter_clause": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS d FROM orders GROUP BY o_orderpriority",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_global": "SELECT count(*) AS n, round(avg(o_totalprice), 2) AS a, max(o_orderdate) AS m FROM orders",
    "agg_group_alias": "SELECT CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_class, count(*) AS n FROM part GROUP BY size_class",
    "agg_group_position": "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2",
    "grouping_sets": "SELECT p_brand, p_type, count(*) AS n, CAST(grouping(p_brand) AS INT) AS g FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rollup": "SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)",
    "agg_median": "SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY p_brand",
    "agg_stats": """SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs,
        round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs FROM lineitem GROUP BY l_returnflag""",
    "agg_regr": """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ic, regr_count(l_extendedprice, l_quantity) AS n,
        round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 2) AS ay FROM lineitem GROUP BY l_returnflag""",
    "agg_percentile_cont": ("SELECT o_orderstatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q FROM orders GROUP BY o_orderstatus",
                            "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS q FROM orders GROUP BY o_orderstatus"),
    "agg_array": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_string": ("SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey"),
    "agg_first_last": ("SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS f, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS l FROM orders GROUP BY o_custkey",
                       "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS f, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY o_custkey"),
    "agg_bit": "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey",
    "agg_bool": "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 400000) AS o FROM orders GROUP BY o_orderstatus",
    "dim_only": "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority",
    # windows
    "win_rank": "SELECT o_custkey, rank() OVER (ORDER BY n DESC) AS rk, dense_rank() OVER (ORDER BY n DESC) AS dr FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t",
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "win_percent": "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 8) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 8) AS cd FROM customer",
    "win_ntile": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INT) AS nt FROM customer",
    "win_lag_lead": "SELECT o_orderkey, lag(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders",
    "win_first_last": """SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "win_running_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS s FROM orders",
    "win_trailing": "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS a FROM orders",
    "win_range": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part",
    "win_groups": ("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part",
                   "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part"),
    "win_share": "SELECT c_custkey, round(c_acctbal / nullif(sum(c_acctbal) OVER (PARTITION BY c_nationkey), 0), 8) AS sh FROM customer",
    "qualify": "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "distinct_on": "SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey",
    "join_right_semi": ("SELECT n_name FROM supplier RIGHT SEMI JOIN nation ON s_nationkey = n_nationkey", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "join_right_anti": ("SELECT c_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45 RIGHT ANTI JOIN customer ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45)"),
    # sets, order, limits
    "union_all": "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_set": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except_set": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0",
    "intersect_all": "SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT c_custkey FROM customer",
    "except_all": "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "order_nulls": "SELECT x, rn FROM (SELECT x, row_number() OVER (ORDER BY x NULLS LAST, k) AS rn FROM (VALUES (1, 3), (2, NULL), (3, 1)) AS v(k, x)) t",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20",
    # subqueries
    "sub_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)",
    "sub_correlated": "SELECT p_partkey FROM part p WHERE p_retailprice >= (SELECT avg(p2.p_retailprice) FROM part p2 WHERE p2.p_brand = p.p_brand) AND p_size < 5",
    "sub_exists_unequal": "SELECT DISTINCT l1.l_orderkey FROM lineitem l1 WHERE l1.l_quantity > 49 AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)",
    "cte_nested": "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT avg(t) AS m FROM a) SELECT o_custkey FROM a CROSS JOIN b WHERE t > 2 * m",
    "cte_recursive": "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r",
    "derived_columns": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) AS t(c_custkey, c_count) GROUP BY c_count",
    # standard decision-support queries on the available columns
    "q01": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
        round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-12-01' GROUP BY l_returnflag, l_linestatus""",
    "q03": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey
        AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q04": """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01'
        AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority""",
    "q05": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey
        AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1995-01-01'
        AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY n_name""",
    "q06": """SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "q07": """SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS INT) AS l_year,
        l_extendedprice * (1 - l_discount) AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey
        AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_regionkey = 1 AND n2.n_regionkey = 2 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31') t
        GROUP BY supp_nation, cust_nation, l_year""",
    "q08": """SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (SELECT CAST(extract(year FROM o_orderdate) AS INT) AS o_year,
        l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey
        AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'EUROPE' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') t GROUP BY o_year""",
    "q10": """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey
        AND o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q12": """SELECT l_returnflag, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low
        FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_returnflag""",
    "q13": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%LOW%' GROUP BY c_custkey) t GROUP BY c_count""",
    "q14": """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem, part
        WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1997-09-01'""",
    "q15": """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY supplier_no)
        SELECT s_suppkey, s_name, total FROM supplier, revenue WHERE s_suppkey = supplier_no AND total = (SELECT max(total) FROM revenue)""",
    "q17": """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#13' AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    "q18": """SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 220)
        AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_totalprice""",
    "q19": """SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
        OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)""",
    "q21": """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND s_nationkey = n_nationkey AND n_regionkey = 2
        AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_quantity > 45) GROUP BY s_name""",
    "q22": """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey IN (3, 5, 7, 11, 13) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY c_nationkey""",
}


def _query(text: str):
    return lambda spark, d: run_sql(spark, d, text)


QUERIES = {n: _query(s if isinstance(s, str) else s[0]) for n, s in SQL.items()}
ORACLE = {n: s if isinstance(s, str) else s[1] for n, s in SQL.items()}
