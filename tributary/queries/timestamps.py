"""Problem 1: shop_orders.ordered_at and customers.created_at as instants in UTC."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import timestamps as ts
from tributary.operators.spread import spread
from tributary.queries.instants import instants
from tributary.queries.tables import table


def _read(spark: SparkSession, d: str, declared: bool) -> DataFrame:
    feeds = table(spark, d, "feeds")
    if not declared:
        feeds = feeds.withColumn("date_order", F.lit(None).cast("string"))
    parts = []
    for name, col in (("shop_orders", "ordered_at"), ("customers", "created_at")):
        rows = ts.with_feeds(spread(table(spark, d, name).select("feed", "delivery_id", col)), feeds)
        parts.append(ts.candidates(rows, col, "feed_zone", "feed_order", F.lit(name).alias("src"), F.col("feed"), F.col("delivery_id").alias("row_id")))
    return ts.normalise(parts[0].unionByName(parts[1]))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, True)


def p1_undeclared(spark: SparkSession, d: str) -> DataFrame:
    """The same where no feed says in which order it writes day and month: the Viterbi pass decides by the rows around."""
    return _read(spark, d, False)


QUERIES = {"p1_found": p1_found, "p1_undeclared": p1_undeclared}
ORACLE = {
    "p1_found": "WITH " + instants("shop_orders", "delivery_id", "ordered_at", "a") + ", " + instants("customers", "delivery_id", "created_at", "b").split("zone_names AS", 1)[1].split(",\n", 1)[1]
    + " SELECT 'shop_orders' AS src, delivery_id AS row_id, utc_us FROM a WHERE utc_us IS NOT NULL UNION ALL SELECT 'customers', delivery_id, utc_us FROM b WHERE utc_us IS NOT NULL"
}
