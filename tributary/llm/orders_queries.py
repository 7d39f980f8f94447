"""Problems 3 and 6 over shop_orders and sales."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import percentiles as pc
from tributary.llm import topn
from tributary.operators.keys import clean_key, current_rows, number
from tributary.queries.tables import table
from tributary.storage import written

N = 5
POINTS = {"p50": 5000, "p90": 9000, "p95": 9500, "p99": 9900}


def _orders(spark: SparkSession, d: str, key: str) -> DataFrame:
    o = current_rows(table(spark, d, "shop_orders"), "id", ["loaded_at", "delivery_id"], "id", key, "total_amount")
    return o.select(clean_key(key).alias("grp"), number("total_amount").alias("value"), "id")


def _sales(spark: SparkSession, d: str, by_day: bool = False) -> DataFrame:
    """Sales without their exact copies; rows that name no id are all kept."""
    s = table(spark, d, "sales").select(clean_key("region").alias("grp"), number("amount").alias("value"), "id", *[F.col("ts").try_cast("date").alias("day")] * by_day)
    return s.filter(F.col("id").isNotNull()).distinct().unionByName(s.filter(F.col("id").isNull()))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for src, rows, score in (("shop_orders", _orders(spark, d, "tenant_id"), "total_amount"), ("sales", _sales(spark, d), "amount")):
        ready = rows.filter(F.col("grp") != "").select("grp", F.col("value").alias("score"), F.col("id").alias("tie"))
        edges = topn.band_edges(table(spark, d, src).select(number(score).alias("score")), "score")
        top = topn.top_n(ready, N, ["grp", "tie"], edges)
        parts.append(top.select(F.lit(src).alias("src"), "grp", F.col("tie").alias("row_id"), "rank_no"))
    return parts[0].unionByName(parts[1])


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery of shop_orders by country: the problem leaves out none but null and NaN, and a day's piece stays as it is when an order comes again."""
    return table(spark, d, "shop_orders").select(clean_key("shipping_country_code").alias("grp"), number("total_amount").alias("value"), F.to_date("loaded_at").alias("day"))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """All rows of shop_orders by country and sales by region; null and blank keys are the group ''."""
    named = lambda src, rows: rows.select(F.struct(F.lit(src).alias("src"), F.coalesce("grp", F.lit("")).alias("key")).alias("grp"), "value")
    out = pc.percentiles(pc.piece(named("shop_orders", _amounts(spark, d)).unionByName(named("sales", _sales(spark, d)))), POINTS)
    return out.select("grp.src", F.col("grp.key").alias("grp"), "n", *POINTS)


def p6_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per group and month, and over all months (month null), both put together from the same pieces of single days."""
    named = lambda src, rows: rows.select(F.struct(F.lit(src).alias("src"), F.coalesce("grp", F.lit("")).alias("key"), "day").alias("grp"), "value")
    days = written(pc.piece(named("shop_orders", _amounts(spark, d)).unionByName(named("sales", _sales(spark, d, True)))), "days")
    month = lambda m: days.select(F.struct("grp.src", "grp.key", m.alias("month")).alias("grp"), "value", "n")
    both = month(F.date_format("grp.day", "yyyy-MM")).unionByName(month(F.lit(None).cast("string")))
    out = pc.percentiles(pc.merge(both), POINTS)
    return out.select("grp.src", F.col("grp.key").alias("grp"), "grp.month", "n", *POINTS)


_TRIM = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)))"
_ROWS = """
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, delivery_id DESC) AS nn FROM shop_orders) WHERE nn = 1),
one AS (SELECT DISTINCT id, region, amount, ts FROM (SELECT id, %s AS region, amount, ts FROM sales)),
r AS (SELECT 'shop_orders' AS src, %s AS grp, id, total_amount AS v, strftime(loaded_at, '%%Y-%%m') AS month FROM %s UNION ALL SELECT 'sales', region, id, amount, left(ts, 7) FROM one)
"""
ORACLE = {
    "p3_found": _ROWS % (_TRIM.format("region"), _TRIM.format("tenant_id"), "cur")
    + f"""SELECT src, grp, id AS row_id, CAST(rank_no AS INTEGER) AS rank_no FROM (
    SELECT *, row_number() OVER (PARTITION BY src, grp ORDER BY v DESC, id) AS rank_no FROM r WHERE grp <> '' AND v IS NOT NULL AND NOT isnan(v)) WHERE rank_no <= {N}""",
    "p6_percentiles": _ROWS % (_TRIM.format("region"), _TRIM.format("shipping_country_code"), "shop_orders")
    + """, k AS (SELECT src, coalesce(grp, '') AS grp, v FROM r WHERE v IS NOT NULL AND NOT isnan(v)),
    s AS (SELECT *, row_number() OVER (PARTITION BY src, grp ORDER BY v) AS i, count(*) OVER (PARTITION BY src, grp) AS n FROM k)
    SELECT src, grp, n, """
    + ", ".join(f"max(v) FILTER (WHERE i = greatest(1, ({bp} * n + 9999) // 10000)) AS {p}" for p, bp in POINTS.items())
    + " FROM s GROUP BY src, grp, n",
}
ORACLE["p6_from_days"] = (
    _ROWS % (_TRIM.format("region"), _TRIM.format("shipping_country_code"), "shop_orders")
    + """, b AS (SELECT src, coalesce(grp, '') AS grp, month, v FROM r WHERE v IS NOT NULL AND NOT isnan(v)), k AS (SELECT * FROM b UNION ALL SELECT src, grp, NULL, v FROM b),
    s AS (SELECT *, row_number() OVER (PARTITION BY src, grp, month ORDER BY v) AS i, count(*) OVER (PARTITION BY src, grp, month) AS n FROM k)
    SELECT src, grp, month, n, """
    + ", ".join(f"max(v) FILTER (WHERE i = greatest(1, ({bp} * n + 9999) // 10000)) AS {p}" for p, bp in POINTS.items())
    + " FROM s GROUP BY src, grp, month, n"
)
QUERIES = {"p3_found": p3_found, "p6_percentiles": p6_percentiles, "p6_from_days": p6_from_days}
