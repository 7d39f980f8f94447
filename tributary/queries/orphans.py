"""Problem 4: customers and orders that shop_orders and order_items refer to in vain."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import orphans as op
from tributary.queries.tables import table


def _found(spark: SparkSession, d: str) -> DataFrame:
    o, c, i = (table(spark, d, n) for n in ("shop_orders", "customers", "order_items"))
    child = o.select(F.lit("shop_orders").alias("src"), F.col("delivery_id").alias("row_id"), F.col("customer_id").alias("ref"), F.col("loaded_at").alias("at"))
    moments = c.select(F.col("id").alias("key"), F.col("loaded_at").alias("at"))
    history = c.select(F.col("id").alias("key"), F.col("loaded_at").alias("at"), F.col("delivery_id").alias("version"), F.col("deleted_at").isNotNull().alias("gone"))
    customers = op.orphans(child, moments, op.deleted_spans(history))
    items = i.select(F.lit("order_items").alias("src"), F.col("item_id").alias("row_id"), F.col("order_id").alias("ref"), F.col("loaded_at").alias("at"))
    named = items.filter(F.col("row_id").isNotNull()).distinct().unionByName(items.filter(F.col("row_id").isNull()))
    return customers.unionByName(op.orphans(named, o.select(F.col("id").alias("key"), F.col("loaded_at").alias("at"))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("src", "row_id", "orphan_kind", F.date_format("at", "yyyy-MM").alias("month_utc"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return op.report(_found(spark, d))


_SQL = """
WITH first_c AS (SELECT id, min(loaded_at) AS f FROM customers WHERE id IS NOT NULL GROUP BY id),
first_o AS (SELECT id, min(loaded_at) AS f FROM shop_orders WHERE id IS NOT NULL GROUP BY id),
spans AS (SELECT id, loaded_at AS since, lead(loaded_at) OVER (PARTITION BY id ORDER BY loaded_at, delivery_id) AS until, deleted_at FROM customers),
x AS (
  SELECT 'shop_orders' AS src, o.delivery_id AS row_id, o.customer_id AS ref, o.loaded_at,
    CASE WHEN c.id IS NULL THEN 'missing' WHEN o.loaded_at < c.f THEN 'late' WHEN s.id IS NOT NULL THEN 'deleted' END AS orphan_kind
  FROM shop_orders o LEFT JOIN first_c c ON o.customer_id = c.id
  LEFT JOIN spans s ON s.id = o.customer_id AND s.deleted_at IS NOT NULL AND o.loaded_at >= s.since AND (s.until IS NULL OR o.loaded_at < s.until)
  WHERE o.customer_id IS NOT NULL
  UNION ALL
  SELECT 'order_items', i.item_id, i.order_id, i.loaded_at, CASE WHEN c.id IS NULL THEN 'missing' WHEN i.loaded_at < c.f THEN 'late' END
  FROM (SELECT DISTINCT item_id, order_id, loaded_at FROM order_items) i LEFT JOIN first_o c ON i.order_id = c.id WHERE i.order_id IS NOT NULL)
"""
QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
ORACLE = {
    "p4_found": _SQL + "SELECT src, row_id, orphan_kind, strftime(loaded_at, '%Y-%m') AS month_utc FROM x WHERE orphan_kind IS NOT NULL",
    "p4_report": _SQL + "SELECT src, orphan_kind, strftime(loaded_at, '%Y-%m') AS month_utc, count(*) AS n_rows, count(DISTINCT ref) AS n_keys FROM x WHERE orphan_kind IS NOT NULL GROUP BY ALL",
}
