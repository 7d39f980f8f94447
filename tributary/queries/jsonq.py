"""JSON helpers and text rewrites over events.props and arrays built from it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import json as J
from tributary.queries.relational import run_sql
from tributary.queries.tables import table


def _e(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def json_get_typed(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return _e(spark, d).select("event_id", J.get_int(p, "k").alias("k"), J.get_str(p, "k").alias("s"), J.get_float(p, "k").alias("f"), J.get_bool(p, "k").alias("b"), J.contains(p, "k").alias("has"), J.get_json(p, "k").alias("j"))


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select("event_id", J.extract_string(F.col("props"), "k").alias("k"), J.extract_string(F.concat(F.lit('{"a":'), "props", F.lit("}")), "a.k").alias("ak"), J.extract_string(F.col("event_type"), "k").alias("bad"))


def json_length(spark: SparkSession, d: str) -> DataFrame:
    arr = F.concat(F.lit("["), F.col("props"), F.lit(",1,null]"))
    return _e(spark, d).select("event_id", J.length(F.col("props")).alias("o"), J.length(arr).alias("a"), F.array_join(J.object_keys(F.col("props")), ",").alias("keys"))


def json_array_explode(spark: SparkSession, d: str) -> DataFrame:
    arr = F.concat(F.lit('["'), F.col("event_type"), F.lit('",'), F.col("user_id").cast("string"), F.lit(",null]"))
    return _e(spark, d).select("event_id", F.explode(J.elements(arr)).alias("x"))


#: A richer text made of each event: an object with every kind of value, a key with a quote in it and an array.
_DOC = """'{"a":{"b":"' || event_type || '","n":' || user_id || ',"f":' || event_id || '.25,"t":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"z":null},"it''s":"q","l":[' || event_id || ',"x",' || props || ']}'"""
_FROM = f"(SELECT event_id, event_type, user_id, props, {_DOC} AS j FROM events) e"


def _sql(text: str):
    return lambda spark, d: run_sql(spark, d, text)


SQL = {
    # several keys and indexes, keys with quotes, other kinds of value than the one asked for
    "json_paths": (
        f"""SELECT event_id, json_get_str(j, 'a', 'b') AS s, json_get_int(j, 'a', 'n') AS n, json_get_float(j, 'a', 'f') AS f, json_get_bool(j, 'a', 't') AS t, json_get_str(j, 'it''s') AS q, json_get_int(j, 'l', 0) AS l0, json_get_str(j, 'l', 1) AS l1,
        json_get_int(j, 'l', 2, 'k') AS lk, json_get_int(j, 'a', 'b') AS wrong, json_get_str(j, 'a', 'n') AS wrong_too, json_get_json(j, 'a', 'b') AS raw, json_get(j, 'l', 2) AS deep, json_contains(j, 'a', 'z') AS has, json_contains(j, 'a', 'y') AS hasnt FROM {_FROM}""",
        f"""SELECT event_id, event_type AS s, user_id AS n, event_id + 0.25::DOUBLE AS f, event_id % 2 = 0 AS t, 'q' AS q, event_id AS l0, 'x' AS l1, CAST(json_extract_string(j, '$.l[2].k') AS BIGINT) AS lk, CAST(NULL AS BIGINT) AS wrong, CAST(NULL AS VARCHAR) AS wrong_too,
        '"' || event_type || '"' AS raw, CAST(json_extract(j, '$.l[2]') AS VARCHAR) AS deep, json_exists(j, '$.a.z') AS has, json_exists(j, '$.a.y') AS hasnt FROM {_FROM}""",
    ),
    "json_lists": (
        f"SELECT event_id, array_join(json_get_array(j, 'l'), '|') AS l, json_length(j, 'l') AS n, json_length(j) AS o, json_length(j, 'a', 'b') AS none, array_join(json_object_keys(j), ',') AS ks, json_extract_string(j, 'a.b') AS ab, json_extract_string(j, 'l[0]') AS step, json_extract_string(j, 'a.n') AS an FROM {_FROM}",
        f"""SELECT event_id, event_id || '|"x"|' || CAST(json_extract(j, '$.l[2]') AS VARCHAR) AS l, CAST(json_array_length(j, '$.l') AS BIGINT) AS n, CAST(len(json_keys(j)) AS BIGINT) AS o, CAST(NULL AS BIGINT) AS none, array_to_string(list_sort(json_keys(j)), ',') AS ks,
        json_extract_string(j, '$.a.b') AS ab, CAST(NULL AS VARCHAR) AS step, json_extract_string(j, '$.a.n') AS an FROM {_FROM}""",
    ),
    "json_operators": (
        f"SELECT event_id, props -> 'k' AS j, props ->> 'k' AS s, j -> 'l' -> 0 AS l0, (j -> 'a') ->> 'b' AS b, props ? 'k' AS has, j ? 'nope' AS hasnt, '[10,20]' -> 0 AS ten FROM {_FROM}",
        f"SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS j, CASE json_type(props, '$.k') WHEN 'VARCHAR' THEN json_extract_string(props, '$.k') END AS s, CAST(json_extract(j, '$.l[0]') AS VARCHAR) AS l0, event_type AS b, json_exists(props, '$.k') AS has, json_exists(j, '$.nope') AS hasnt, '10' AS ten FROM {_FROM}",
    ),
    "json_unnest": ("SELECT event_id, e FROM (SELECT event_id, unnest(from_json('[\"' || event_type || '\",' || user_id || ',null,{\"a\":1}]')) AS e FROM events) t", "SELECT event_id, unnest([event_type, CAST(user_id AS VARCHAR), 'null', '{\"a\":1}']) AS e FROM events"),
    "scalar_names": ("SELECT p_partkey, strpos(p_name, ' ') AS p, starts_with(p_name, 'red') AS r, to_hex(p_partkey) AS h, gcd(p_partkey, 36) AS g, sha256(p_name) AS sh FROM part",
                     "SELECT p_partkey, CAST(strpos(p_name, ' ') AS INT) AS p, starts_with(p_name, 'red') AS r, lower(to_hex(p_partkey)) AS h, gcd(p_partkey, 36) AS g, sha256(p_name) AS sh FROM part"),
}
QUERIES = {f.__name__: f for f in (json_get_typed, json_extract, json_length, json_array_explode)} | {n: _sql(s[0]) for n, s in SQL.items()}
_KIND = "CASE json_type(props, '$.k') WHEN '{}' THEN CAST(json_extract_string(props, '$.k') AS {}) END"
ORACLE = {
    "json_get_typed": f"SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, {_KIND.format('VARCHAR', 'VARCHAR')} AS s, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS f, {_KIND.format('BOOLEAN', 'BOOLEAN')} AS b, json_exists(props, '$.k') AS has, CAST(json_extract(props, '$.k') AS VARCHAR) AS j FROM events",
    "json_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string('{\"a\":' || props || '}', '$.a.k') AS ak, CAST(CASE WHEN json_valid(event_type) THEN json_extract_string(event_type, '$.k') END AS VARCHAR) AS bad FROM events",
    "json_length": "SELECT event_id, CAST(len(json_keys(props)) AS BIGINT) AS o, CAST(json_array_length('[' || props || ',1,null]') AS BIGINT) AS a, array_to_string(json_keys(props), ',') AS keys FROM events",
    "json_array_explode": "SELECT event_id, unnest([event_type, CAST(user_id AS VARCHAR), 'null']) AS x FROM events",
} | {n: s[1] for n, s in SQL.items()}
