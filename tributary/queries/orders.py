"""Problems 2 and 5: features and rolling totals of the current rows of shop_orders, built at once and kept up by increments."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import features, rolling
from tributary.operators import timestamps as ts
from tributary.operators.keys import clean_key, current_rows, day_of
from tributary.operators.spread import spread
from tributary.queries.instants import instants
from tributary.queries.tables import table
from tributary.storage import new_path, written

DAY_US = 86_400_000_000
#: Moment up to which deliveries are loaded before the increment, and how far before the last order the window of p2_incremental ends and how long it is.
CUT, BACK_US, LONG_US = "2026-03-01 12:00:00", 40 * DAY_US, 200 * DAY_US


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery with its instant, read off where it is scanned, so that only the instant and not its text is shuffled."""
    o = spread(table(spark, d, "shop_orders").select("id", "loaded_at", "delivery_id", "customer_id", "status", "total_amount", "ordered_at", "feed"))
    keep = [F.col(c) for c in ("id", "loaded_at", "delivery_id", "customer_id")]
    return ts.declared_instant(o, table(spark, d, "feeds"), "ordered_at", *keep, clean_key("status").alias("type"), F.col("total_amount").alias("amount")).withColumnsRenamed({"customer_id": "entity", "utc_us": "at_us"})


def _current(deliveries: DataFrame, *keep: str) -> DataFrame:
    return current_rows(deliveries, "id", ["loaded_at", "delivery_id"], *keep)


_EVENT = ("entity", "type", "at_us", "amount")


def _named(f: DataFrame) -> DataFrame:
    return f.select(F.col("entity").cast("bigint").alias("customer_id"), F.col("n").alias("n_orders"), "total", "types")


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    """Per customer and status count, total and recency, from a store that is built from nothing; p2_incremental keeps one up.

    Recency is measured to the last readable ordered_at of all current orders.
    """
    store = features.FeatureStore(spark, new_path(spark, "features"))
    e = _current(_deliveries(spark, d), *_EVENT)
    store.update(e)
    as_of = store.manifest().agg(F.max("high_us")).first()[0] or 0
    return _named(store.features(e, as_of))


def _by_type(f: DataFrame) -> DataFrame:
    t = f.select("customer_id", F.explode("types").alias("t"))
    return t.select("customer_id", F.col("t.type").alias("status"), F.col("t.n").alias("n_orders"), F.round("t.total", 2).alias("total"), F.col("t.recency_us").alias("recency_us"))


def p2_by_type(spark: SparkSession, d: str) -> DataFrame:
    """p2_features with a row per customer and status."""
    return _by_type(p2_features(spark, d))


def p2_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Features over a window that begins and ends within months, from a store that was built up to CUT and then brought up to date by the later deliveries.

    Only months that a late delivery takes an order from or puts one into are recomputed, from events that are stored by month.
    """
    o = written(_deliveries(spark, d), "deliveries")
    before, late = o.filter(F.col("loaded_at") <= F.lit(CUT).cast("timestamp_ntz")), o.filter(~(F.col("loaded_at") <= F.lit(CUT).cast("timestamp_ntz")) | F.col("loaded_at").isNull())
    store = features.FeatureStore(spark, new_path(spark, "features"))
    old = _current(before, "id", *_EVENT)
    store.update(old)
    month = features.bucket_of("at_us").alias("month")
    now = written(_current(o, "id", *_EVENT).withColumn("month", month), "events", "month")
    ids = late.select("id").distinct()
    touched = old.join(ids, "id", "left_semi").select(month).unionByName(now.join(ids, "id", "left_semi").select("month")).distinct()
    months = sorted(r[0] for r in touched.collect())
    store.update(now.filter(F.col("month").isin(months)), only=months)
    as_of = (store.manifest().agg(F.max("high_us")).first()[0] or 0) - BACK_US
    since = as_of - LONG_US
    edges = [(us // DAY_US) for us in (since, as_of)]
    ends = [features.bucket_of_day(x) for x in edges]
    return _by_type(_named(store.features(now.filter(F.col("month").isin(ends)), as_of, since)))


def _days(out: DataFrame) -> DataFrame:
    return out.select(F.col("entity").alias("customer_id"), F.date_from_unix_date("day").alias("day"), "total_7d", "avg_7d", "total_30d", "avg_30d")


def _rounded(out: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order in the last places; rounded to what doesn't. rint isn't dear as round is, which goes by decimals."""
    places = lambda c, n: F.rint(c * F.lit(10.0**n)) / F.lit(10.0**n)
    out = out.select("customer_id", "day", *[places(F.col(f"total_{p}d"), 4).alias(f"total_{p}d") for p in (7, 30)])
    return out.select("customer_id", "day", *[c for p in (7, 30) for c in (F.col(f"total_{p}d"), places(F.col(f"total_{p}d") / F.lit(p), 6).alias(f"avg_{p}d"))])


def p5_rolling(spark: SparkSession, d: str) -> DataFrame:
    days = rolling.daily(_current(_deliveries(spark, d), "entity", "at_us", "amount"))
    return _days(rolling.trailing(rolling.trees(days)))


def p5_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The same from trees that were built up to CUT and then corrected by the later deliveries: only the days that a late delivery takes an order from or puts
    one into are counted again, and only their leaves and ancestors change."""
    o = written(_deliveries(spark, d), "deliveries")
    before, late = o.filter(F.col("loaded_at") <= F.lit(CUT).cast("timestamp_ntz")), o.filter(~(F.col("loaded_at") <= F.lit(CUT).cast("timestamp_ntz")) | F.col("loaded_at").isNull())
    old = _current(before, "id", "entity", "at_us", "amount")
    tree = written(rolling.trees(rolling.daily(old)), "trees", "shard")
    now, ids = written(_current(o, "id", "entity", "at_us", "amount"), "current"), late.select("id").distinct()
    day = day_of("at_us").alias("day")
    touched = [x.join(ids, "id", "left_semi").select("entity", day) for x in (old, now)]
    touched.append(late.filter(F.col("id").isNull()).select("entity", day))
    named = written(touched[0].unionByName(touched[1]).unionByName(touched[2]).filter(F.col("entity").isNotNull() & F.col("day").isNotNull()).distinct(), "touched")
    again = rolling.daily(now.withColumn("day", day).join(named, ["entity", "day"], "left_semi"))
    days = named.join(again, ["entity", "day"], "left").select("entity", "day", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return _days(rolling.trailing(rolling.corrected(tree, days)))


_CURRENT = f"""WITH {instants("shop_orders", "delivery_id", "ordered_at")},
trimmed AS (SELECT *, coalesce(lower(trim(status, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))), '') AS st FROM shop_orders),
cur AS (SELECT o.*, i.utc_us FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, delivery_id DESC) AS nn FROM trimmed) o JOIN inst i USING (delivery_id) WHERE nn = 1 OR id IS NULL),
ev AS (SELECT customer_id, st, CASE WHEN NOT isnan(total_amount) THEN total_amount END AS amount, utc_us FROM cur WHERE customer_id IS NOT NULL)"""
_BY = "SELECT customer_id, st AS status, count(*) AS n_orders, round(sum(amount), 2) AS total, {as_of} - max(utc_us) AS recency_us FROM ev{where} GROUP BY 1, 2"
_END = f"((SELECT max(utc_us) FROM ev) - {BACK_US})"
_ROLLING = (
    _CURRENT
    + """, dd AS (SELECT customer_id, utc_us // 86400000000 - CASE WHEN utc_us % 86400000000 < 0 THEN 1 ELSE 0 END AS day, coalesce(sum(amount), 0) AS x FROM ev WHERE utc_us IS NOT NULL GROUP BY 1, 2),
    span AS (SELECT customer_id, unnest(generate_series(min(day), max(day))) AS day FROM dd GROUP BY customer_id),
    full_days AS (SELECT s.customer_id, s.day, coalesce(x, 0) AS x FROM span s LEFT JOIN dd USING (customer_id, day)),
    r AS (SELECT customer_id, DATE '1970-01-01' + CAST(day AS INTEGER) AS day, sum(x) OVER (PARTITION BY customer_id ORDER BY day ROWS 6 PRECEDING) AS t7, sum(x) OVER (PARTITION BY customer_id ORDER BY day ROWS 29 PRECEDING) AS t30 FROM full_days)
    SELECT customer_id, day, round(t7, 4) AS total_7d, round(round(t7, 4) / 7, 6) AS avg_7d, round(t30, 4) AS total_30d, round(round(t30, 4) / 30, 6) AS avg_30d FROM r"""
)
QUERIES = {
    "p2_features": p2_features, "p2_by_type": p2_by_type, "p2_incremental": p2_incremental, "p5_rolling": lambda spark, d: _rounded(p5_rolling(spark, d)), "p5_corrected": lambda spark, d: _rounded(p5_corrected(spark, d)),
}
ORACLE = {
    "p2_by_type": _CURRENT + _BY.format(as_of="(SELECT max(utc_us) FROM ev)", where=""),
    "p2_incremental": _CURRENT + _BY.format(as_of=_END, where=f" WHERE utc_us BETWEEN {_END} - {LONG_US} AND {_END}"),
    "p5_rolling": _ROLLING,
    "p5_corrected": _ROLLING,
}
