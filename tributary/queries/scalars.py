"""Scalar function families and approximate aggregates; pairs of (Spark SQL, DuckDB SQL) where the names differ."""

from __future__ import annotations

from tributary.queries.relational import run_sql

SQL: dict[str, str | tuple[str, str]] = {
    "fn_string": (
        """SELECT p_partkey, ascii(p_name) AS a, bit_length(p_name) AS bl, btrim(concat(' ', p_name, ' ')) AS bt, char_length(p_name) AS cl, concat_ws('-', p_brand, p_type) AS cw, contains(p_name, 'red') AS ct, initcap(p_name) AS ic,
        left(p_name, 3) AS l, right(p_name, 3) AS r, levenshtein(p_name, p_type) AS lv, lower(p_type) AS lo, upper(p_name) AS u, lpad(p_type, 12, '*') AS lp, rpad(p_type, 12, '*') AS rp, md5(p_name) AS m, octet_length(p_name) AS ol,
        repeat(p_type, 2) AS rep, replace(p_name, ' ', '_') AS rpl, reverse(p_name) AS rev, split_part(p_brand, '#', 2) AS sp, substring(p_name, 2, 4) AS ss, translate(p_name, 'aei', 'AEI') AS tr, find_in_set('MEDIUM', 'SMALL,MEDIUM') AS fs, chr(65) AS ch FROM part""",
        """SELECT p_partkey, ascii(p_name) AS a, CAST(bit_length(p_name) AS INT) AS bl, trim(concat(' ', p_name, ' ')) AS bt, CAST(length(p_name) AS INT) AS cl, concat_ws('-', p_brand, p_type) AS cw, contains(p_name, 'red') AS ct,
        array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_name, ' ')], ' ') AS ic, left(p_name, 3) AS l, right(p_name, 3) AS r, CAST(levenshtein(p_name, p_type) AS INT) AS lv, lower(p_type) AS lo, upper(p_name) AS u,
        lpad(p_type, 12, '*') AS lp, rpad(p_type, 12, '*') AS rp, md5(p_name) AS m, CAST(octet_length(encode(p_name)) AS INT) AS ol, repeat(p_type, 2) AS rep, replace(p_name, ' ', '_') AS rpl, reverse(p_name) AS rev,
        split_part(p_brand, '#', 2) AS sp, substring(p_name, 2, 4) AS ss, translate(p_name, 'aei', 'AEI') AS tr, 2 AS fs, chr(65) AS ch FROM part""",
    ),
    "fn_regex": (
        "SELECT p_partkey, regexp_like(p_name, '^r.d') AS l, regexp_replace(p_brand, '[0-9]+', 'n') AS r, regexp_extract(p_brand, '#([0-9])', 1) AS e, regexp_count(p_name, 'e') AS c, regexp_instr(p_name, 'i') AS i FROM part",
        "SELECT p_partkey, regexp_matches(p_name, '^r.d') AS l, regexp_replace(p_brand, '[0-9]+', 'n', 'g') AS r, regexp_extract(p_brand, '#([0-9])', 1) AS e, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS INT) AS c, CAST(strpos(p_name, 'i') AS INT) AS i FROM part",
    ),
    "fn_math": """SELECT p_partkey, abs(p_size - 25) AS a, round(cbrt(p_retailprice), 6) AS cb, ceil(p_retailprice / 7) AS ce, floor(p_retailprice / 7) AS fl, round(exp(p_size / 50.0), 6) AS ex, round(ln(p_retailprice), 6) AS ln_, round(log10(p_retailprice), 6) AS l10,
        round(log2(p_retailprice), 6) AS l2, round(power(p_size, 1.5), 4) AS pw, round(radians(p_size), 8) AS ra, round(degrees(p_size), 4) AS de, sign(p_size - 25) AS sg, round(sin(p_size), 8) AS si, round(cos(p_size), 8) AS co, round(tan(p_size), 6) AS ta,
        round(atan2(p_size, 3), 8) AS at2, round(sinh(p_size / 50.0), 8) AS sh, round(sqrt(p_retailprice), 6) AS sq, round(pi(), 8) AS pi_, factorial(p_size % 10) AS fa, p_size % 7 AS md, greatest(p_size, 20, 3) AS gr, least(p_size, 20, 3) AS le FROM part""",
    "fn_date": (
        """SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP_NTZ) AS q, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP_NTZ) AS w, CAST(date_part('doy', o_orderdate) AS BIGINT) AS dy, CAST(date_part('quarter', o_orderdate) AS BIGINT) AS qu,
        make_date(2024, 1 + CAST(o_orderkey % 12 AS INT), 1) AS md, date_format(o_orderdate, 'yyyy/MM/dd') AS f, to_date('2024-02-29') AS td, CAST(o_orderdate + INTERVAL '1' MONTH AS TIMESTAMP_NTZ) AS nm, datediff(o_orderdate, DATE '1995-01-01') AS dd,
        date_bin(172800, o_orderdate, TIMESTAMP_NTZ '1995-01-01 00:00:00') AS bin, unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS um, last_day(o_orderdate) AS ld FROM orders""",
        """SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS w, CAST(date_part('doy', o_orderdate) AS BIGINT) AS dy, CAST(date_part('quarter', o_orderdate) AS BIGINT) AS qu,
        make_date(2024, 1 + o_orderkey % 12, 1) AS md, strftime(o_orderdate, '%Y/%m/%d') AS f, DATE '2024-02-29' AS td, o_orderdate + INTERVAL '1' MONTH AS nm, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS dd,
        time_bucket(INTERVAL '2 days', o_orderdate, TIMESTAMP '1995-01-01') AS bin, epoch_us(o_orderdate) AS um, last_day(o_orderdate) AS ld FROM orders""",
    ),
    "fn_conditional": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'x') AS c, ifnull(nullif(o_orderstatus, 'O'), 'y') AS i, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS k, if(o_totalprice > 200000, 'a', 'b') AS f FROM orders",
    "fn_array": (
        """SELECT n_nationkey AS k, array_join(array_append(a, 9), ',') AS ap, array_join(array_prepend(a, 9), ',') AS pr, array_join(concat(a, b), ',') AS cc, array_contains(a, 3) AS ct, array_join(sort_array(array_distinct(concat(a, b))), ',') AS di,
        element_at(a, 2) AS el, array_join(sort_array(array_except(a, b)), ',') AS ex, array_join(sort_array(array_intersect(a, b)), ',') AS it, array_join(sort_array(array_union(a, b)), ',') AS un, size(a) AS ln, array_max(a) AS mx, array_min(a) AS mn,
        array_position(a, 3) AS po, array_join(filter(a, x -> x <> 3), ',') AS re, array_join(reverse(a), ',') AS rv, array_join(slice(a, 2, 2), ',') AS sl, arrays_overlap(a, b) AS ov, array_join(flatten(array(a, b)), ',') AS fl, array_join(sequence(1, 4), ',') AS sq,
        array_join(array_repeat(n_nationkey, 2), ',') AS rp, array_join(transform(a, x -> x * 2), ',') AS tf FROM (SELECT n_nationkey, array(n_nationkey, 3, n_regionkey) AS a, array(3, 4, n_regionkey) AS b FROM nation) t""",
        """SELECT n_nationkey AS k, array_to_string(list_append(a, 9), ',') AS ap, array_to_string(list_prepend(9, a), ',') AS pr, array_to_string(list_concat(a, b), ',') AS cc, list_contains(a, 3) AS ct, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS di,
        a[2] AS el, array_to_string(list_sort(list_distinct([x for x in a if NOT list_contains(b, x)])), ',') AS ex, array_to_string(list_sort(list_distinct([x for x in a if list_contains(b, x)])), ',') AS it, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS un,
        CAST(len(a) AS INT) AS ln, list_max(a) AS mx, list_min(a) AS mn, CAST(list_position(a, 3) AS BIGINT) AS po, array_to_string([x for x in a if x <> 3], ',') AS re, array_to_string(list_reverse(a), ',') AS rv, array_to_string(a[2:3], ',') AS sl, true AS ov,
        array_to_string(flatten([a, b]), ',') AS fl, array_to_string(generate_series(1, 4), ',') AS sq, array_to_string([n_nationkey, n_nationkey], ',') AS rp, array_to_string([x * 2 for x in a], ',') AS tf
        FROM (SELECT n_nationkey, [n_nationkey, 3, n_regionkey] AS a, [3, 4, n_regionkey] AS b FROM nation) t""",
    ),
    "fn_struct_map": (
        "SELECT n_nationkey AS k, s.a AS a, element_at(m, 'x') AS x, array_join(map_keys(m), ',') AS ks, array_join(map_values(m), ',') AS vs, size(map_entries(m)) AS n FROM (SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey) AS s, map('x', n_nationkey, 'y', n_regionkey) AS m FROM nation) t",
        "SELECT n_nationkey AS k, n_name AS a, n_nationkey AS x, 'x,y' AS ks, n_nationkey || ',' || n_regionkey AS vs, 2 AS n FROM nation",
    ),
    "fn_typeof": ("SELECT typeof(n_nationkey) AS t, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1", "SELECT 'int' AS t, count(*) AS n FROM nation"),
    "unnest_rows": ("SELECT n_nationkey AS k, explode(sequence(0, n_regionkey)) AS x FROM nation", "SELECT n_nationkey AS k, CAST(unnest(generate_series(0, n_regionkey)) AS INT) AS x FROM nation"),
    # names that Spark lacks
    "fn_names_string": (
        "SELECT p_partkey, substr_index(p_brand, '#', 1) AS si, lower(hex(digest(p_name, 'sha256'))) AS dg, to_char(DATE '2024-03-05', '%Y/%m/%d') AS tc, iszero(p_size - 7) AS iz, trunc(p_retailprice) AS tn, trunc(p_retailprice, 1) AS t1, lcm(p_size, 6) AS lc FROM part",
        "SELECT p_partkey, split_part(p_brand, '#', 1) AS si, sha256(p_name) AS dg, '2024/03/05' AS tc, p_size = 7 AS iz, trunc(p_retailprice) AS tn, trunc(p_retailprice * 10) / 10 AS t1, lcm(p_size, 6) AS lc FROM part",
    ),
    "fn_names_time": (
        "SELECT o_orderkey, to_timestamp_seconds(o_orderkey) AS s, to_timestamp_millis(o_orderkey) AS ms, to_timestamp_micros(o_orderkey) AS us, to_timestamp_nanos(o_orderkey * 1000) AS ns, to_unixtime(o_orderdate) AS u, to_local_time(o_orderdate) AS l FROM orders",
        "SELECT o_orderkey, make_timestamp(o_orderkey * 1000000) AS s, make_timestamp(o_orderkey * 1000) AS ms, make_timestamp(o_orderkey) AS us, make_timestamp(o_orderkey) AS ns, CAST(epoch(o_orderdate) AS BIGINT) AS u, o_orderdate AS l FROM orders",
    ),
    "fn_names_array": (
        """SELECT k, array_to_string(array_concat(a, b), ',') AS cc, array_has(a, 3) AS h, array_has_all(a, make_array(3, k)) AS ha, array_has_any(a, b) AS hy, array_element(a, -1) AS el, array_element(a, 9) AS far, array_length(a) AS n, array_to_string(array_positions(a, 3), ',') AS ps,
        array_to_string(array_remove(a, 3), ',') AS r1, array_to_string(array_remove_n(a, 3, 2), ',') AS r2, array_to_string(array_remove_all(a, 3), ',') AS ra, array_to_string(array_replace(a, 3, 9), ',') AS p1, array_to_string(array_replace_n(a, 3, 9, 2), ',') AS p2,
        array_to_string(array_replace_all(a, 3, 9), ',') AS pa, array_to_string(array_resize(a, 2), ',') AS z2, array_to_string(array_resize(a, 6, 0), ',') AS z6, array_to_string(array_reverse(a), ',') AS rv, array_to_string(array_slice(a, 2, 3), ',') AS sl, array_to_string(array_slice(a, -2, -1), ',') AS sn,
        array_any_value(a) AS av, array_to_string(array_dims(a), ',') AS dm, array_ndims(make_array(a)) AS nd, round(array_distance(a, make_array(0, 0, 0, 0)), 6) AS di, array_to_string(array_pop_back(a), ',') AS pb, array_to_string(array_pop_front(a), ',') AS pf, empty(a) AS em,
        array_to_string(range(1, 5), ',') AS rg, array_to_string(range(3, 3), ',') AS r0 FROM (SELECT n_nationkey AS k, make_array(3, n_nationkey, 3, n_regionkey) AS a, make_array(3, 4) AS b FROM nation) t""",
        """SELECT k, array_to_string(list_concat(a, b), ',') AS cc, true AS h, true AS ha, true AS hy, a[-1] AS el, CAST(NULL AS INTEGER) AS far, CAST(len(a) AS BIGINT) AS n, array_to_string([i for i in range(1, 5) if a[i] = 3], ',') AS ps,
        array_to_string(a[2:], ',') AS r1, array_to_string(CASE WHEN k = 3 THEN a[3:] ELSE [a[2]] || a[4:] END, ',') AS r2, array_to_string([x for x in a if x <> 3], ',') AS ra, array_to_string([9] || a[2:], ',') AS p1, array_to_string(CASE WHEN k = 3 THEN [9, 9] || a[3:] ELSE [9, a[2], 9, a[4]] END, ',') AS p2,
        array_to_string([CASE WHEN x = 3 THEN 9 ELSE x END for x in a], ',') AS pa, array_to_string(a[:2], ',') AS z2, array_to_string(a || [0, 0], ',') AS z6, array_to_string(list_reverse(a), ',') AS rv, array_to_string(a[2:3], ',') AS sl, array_to_string(a[3:4], ',') AS sn,
        3 AS av, '4' AS dm, CAST(2 AS BIGINT) AS nd, round(sqrt(list_sum([x * x for x in a])), 6) AS di, array_to_string(a[:3], ',') AS pb, array_to_string(a[2:], ',') AS pf, false AS em, '1,2,3,4' AS rg, '' AS r0
        FROM (SELECT n_nationkey AS k, [3, n_nationkey, 3, n_regionkey] AS a, [3, 4] AS b FROM nation) t""",
    ),
    "fn_names_other": (
        "SELECT n_nationkey AS k, get_field(named_struct('a', n_name), 'a') AS f, get_field(row(n_name, 7), 'c1') AS c1, element_at(make_map('x', n_nationkey, 'y', n_regionkey), 'y') AS m, array_to_string(map_extract(make_map('x', n_nationkey), 'x'), ',') AS mx, size(map_extract(make_map('x', 1), 'q')) AS mn, arrow_cast(n_nationkey, 'Int64') AS c, arrow_cast(n_nationkey, 'Utf8') AS u, arrow_typeof(n_name) AS ty, arrow_typeof(n_nationkey) AS ti FROM nation",
        "SELECT n_nationkey AS k, n_name AS f, 7 AS c1, n_regionkey AS m, CAST(n_nationkey AS VARCHAR) AS mx, 0 AS mn, CAST(n_nationkey AS BIGINT) AS c, CAST(n_nationkey AS VARCHAR) AS u, 'Utf8' AS ty, 'Int32' AS ti FROM nation",
    ),
    "agg_weighted": ("SELECT o_orderstatus, approx_percentile_cont_with_weight(o_totalprice, 1 + o_orderkey % 3, 0.5) AS w FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS w FROM (SELECT o_orderstatus, o_totalprice, unnest(range(1 + o_orderkey % 3)) FROM orders) GROUP BY o_orderstatus"),
    # sketches differ from one engine to another: within a tenth of the exact value
    "agg_approx_near": ("SELECT o_orderstatus, abs(approx_distinct(o_custkey) / count(DISTINCT o_custkey) - 1) < 0.1 AS d, abs(approx_median(o_totalprice) / median(o_totalprice) - 1) < 0.1 AS m, abs(approx_percentile_cont(o_totalprice, 0.9) / percentile(o_totalprice, 0.9) - 1) < 0.1 AS p FROM orders GROUP BY o_orderstatus",
                        "SELECT o_orderstatus, count(*) > 0 AS d, count(*) > 0 AS m, count(*) > 0 AS p FROM orders GROUP BY o_orderstatus"),
}
#: Sketches differ from one engine to another, so this has no SQL to compare with; agg_approx_near compares it with the exact values.
ROWS_ONLY = {
    "agg_approx": "SELECT o_orderstatus, approx_distinct(o_custkey) AS d, approx_median(o_totalprice) AS m, approx_percentile_cont(o_totalprice, 0.9) AS w FROM orders GROUP BY o_orderstatus",
}


def _query(text: str):
    return lambda spark, d: run_sql(spark, d, text)


QUERIES = {n: _query(s if isinstance(s, str) else s[0]) for n, s in (SQL | ROWS_ONLY).items()}
ORACLE = {n: s if isinstance(s, str) else s[1] for n, s in SQL.items()}
