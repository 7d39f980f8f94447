"""Problem 7: count and total of shop_orders per tenant and per customer."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import skew
from tributary.operators.keys import clean_key
from tributary.queries.tables import table
from tributary.storage import written

#: Least share of all rows of a key in p7_found.
SHARE = 0.02
ROW = ["delivery_id", "loaded_at", "total_amount"]


def _totals(spark: SparkSession, d: str) -> DataFrame:
    keyed = {"tenant_id": clean_key("tenant_id"), "customer_id": F.col("customer_id").cast("string")}
    return skew.salted_totals(table(spark, d, "shop_orders").select("tenant_id", "customer_id", *ROW), keyed, "total_amount", ROW)


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d).select("field_name", F.col("key").alias("key_value"), "n_rows", "n_amounts", F.round("total", 4).alias("total_amount"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    totals = written(_totals(spark, d), "totals")  # one row a key, read twice
    return skew.frequent(totals, SHARE).select("field_name", F.col("key").alias("key_value"))


_SQL = """
WITH k AS (SELECT 'tenant_id' AS field_name, lower(trim(tenant_id, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))) AS key_value, total_amount FROM shop_orders
           UNION ALL SELECT 'customer_id', CAST(customer_id AS VARCHAR), total_amount FROM shop_orders),
t AS (SELECT field_name, key_value, count(*) AS n_rows, count(*) FILTER (WHERE NOT isnan(total_amount)) AS n_amounts,
             round(sum(total_amount) FILTER (WHERE NOT isnan(total_amount)), 4) AS total_amount FROM k GROUP BY ALL)
"""
QUERIES = {"p7_found": p7_found, "p7_totals": p7_totals}
ORACLE = {
    "p7_found": _SQL + f"SELECT field_name, key_value FROM t WHERE key_value IS NOT NULL AND n_rows >= {SHARE} * (SELECT count(*) FROM shop_orders)",
    "p7_totals": _SQL + "SELECT * FROM t",
}
