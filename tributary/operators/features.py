"""Per-entity feature tables from events, kept up by time-bucketed partial aggregates (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.keys import day_of

#: Bucket of events whose moment is unknown.
UNDATED = 0
_PARTIAL = "entity string, type string, n bigint, n_amounts bigint, total double, last_us bigint"
_MANIFEST = "bucket int, n bigint, mark decimal(38,0), high_us bigint"


def bucket_of(us: str) -> F.Column:
    """Calendar month of a moment as a number, year * 12 + month - 1; UNDATED for null."""
    t = F.date_from_unix_date(day_of(us))  # in UTC whatever the session's zone is
    return F.when(F.col(us).isNull(), F.lit(UNDATED)).otherwise(F.year(t) * 12 + F.month(t) - 1).cast("int")


def bucket_of_day(day: int) -> int:
    """The same of a day since 1970."""
    from datetime import date, timedelta

    t = date(1970, 1, 1) + timedelta(days=day)
    return t.year * 12 + t.month - 1


def month_start(bucket: int) -> int:
    """First microsecond of a bucket."""
    from datetime import datetime, timezone

    return int(datetime(bucket // 12, bucket % 12 + 1, 1, tzinfo=timezone.utc).timestamp()) * 1_000_000


def _partials(events: DataFrame, more: list = (), *by: str) -> DataFrame:
    value = F.when(~F.isnan("amount"), F.col("amount"))
    return events.groupBy("entity", "type", *by).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("n_amounts"), F.sum(value).alias("total"), F.max("at_us").alias("last_us"), *more
    )


class FeatureStore:
    """Partial aggregates by entity, type and month in ``path``; ``update`` recomputes the months whose events changed, ``features`` merges them.

    Events are (entity, type, at_us, amount). Null entities belong to nobody and are left out; a null type is the type ''; null and NaN amounts count as events
    only, infinite ones are summed; events without a moment are kept in a bucket of their own, which counts wherever no lower bound is asked for. Repeated events count each time.
    Each update writes new folders and then a manifest that lists them, so a reader never sees half an update and a failed one leaves the old state.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        fs, p = self._fs()
        if not fs.exists(p):
            return 0
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        done = [int(n[9:]) for n in names if n.startswith("manifest-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=0)

    def manifest(self) -> DataFrame:
        """(bucket, n, mark, high_us, version): per month the events, a fingerprint of them, the last moment and the update that wrote its partials."""
        v = self.version()
        schema = _MANIFEST + ", version int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/manifest-{v}") if v else self.spark.createDataFrame([], schema)

    @staticmethod
    def _events(events: DataFrame) -> DataFrame:
        e = events.select(F.col("entity").cast("string"), F.coalesce("type", F.lit("")).alias("type"), F.col("at_us").cast("bigint"), F.col("amount").cast("double"))
        return e.filter(F.col("entity").isNotNull()).withColumn("bucket", bucket_of("at_us"))

    def update(self, events: DataFrame, only: list[int] | None = None) -> list[int]:
        """Bring the store to the state of ``events`` (all of them); returns the months that were recomputed. The number of months bounds what the driver sees.

        Each event is read once: partials, and with them a fingerprint per month, come from one aggregation, and those of months that didn't change are
        dropped. Where the caller knows which months can have changed, ``only`` names them and events of other months aren't looked at; kept in a table that
        is partitioned by bucket they aren't even read.
        """
        e = self._events(events)
        if only is not None:
            e = e.filter(F.col("bucket").isin(only)) if only else e.limit(0)
        mark = F.sum(F.pmod(F.xxhash64("entity", "type", "at_us", "amount"), F.lit(2**62)).cast("decimal(20,0)")).cast("decimal(38,0)").alias("mark")
        v = self.version() + 1
        place = f"{self.path}/partials-{v}"
        _partials(e, [mark], "bucket").hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)  # files of a month as its rows ask for
        fresh = self.spark.read.schema("n bigint, last_us bigint, mark decimal(38,0), bucket int").parquet(place)
        per = fresh.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("mark").cast("decimal(38,0)").alias("mark"), F.max("last_us").alias("high_us"))
        now = {r["bucket"]: r for r in per.collect()}
        was = {r["bucket"]: r for r in self.manifest().collect()}
        looked = set(now) | set(was) if only is None else set(only)
        changed = {b for b, r in now.items() if b not in was or (was[b]["n"], was[b]["mark"]) != (r["n"], r["mark"])}
        gone = {b for b in was if b in looked and b not in now}
        fs, p = self._fs()
        for b in now.keys() - changed if changed else ["*"]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(place if b == "*" else f"{place}/bucket={b}"), True)
        if not changed and not gone:
            return []
        rows = [(b, r["n"], r["mark"], r["high_us"], v if b in changed else was[b]["version"]) for b, r in sorted(now.items())]
        rows += [(b, r["n"], r["mark"], r["high_us"], r["version"]) for b, r in sorted(was.items()) if b not in looked]
        self.spark.createDataFrame(rows, _MANIFEST + ", version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{v}")
        return sorted(changed)

    def vacuum(self) -> list[str]:
        """Delete manifests before the last one and partials that it doesn't name; for when no reader of an earlier state is left."""
        fs, p = self._fs()
        keep = {f"manifest-{self.version()}"} | {f"partials-{r['version']}" for r in self.manifest().select("version").distinct().collect()}
        gone = sorted(n for x in fs.listStatus(p) if (n := x.getPath().getName()) not in keep)
        for n in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)
        return gone

    def _stored(self, buckets: dict[int, int]) -> DataFrame:
        """Partials of the buckets, each from the update that wrote it last."""
        out = self.spark.createDataFrame([], _PARTIAL)
        for v in sorted(set(buckets.values())):
            own = [b for b, x in buckets.items() if x == v]
            t = self.spark.read.schema(_PARTIAL + ", bucket int").parquet(f"{self.path}/partials-{v}")
            out = out.unionByName(t.filter(F.col("bucket").isin(own)).drop("bucket"))
        return out

    def features(self, events: DataFrame, as_of_us: int, since_us: int | None = None) -> DataFrame:
        """(entity, n, total, types): one row per entity over the events from ``since_us`` to ``as_of_us``, both included.

        types is an array, by type, of (type, n, n_amounts, total, recency_us), recency_us being the time from the type's last event to as_of_us (null when no
        event of the type has a moment); total is null where no amount is a number. Whole months come from the store, the first and last one from ``events``.
        """
        m = {r["bucket"]: r for r in self.manifest().collect()}
        whole = {}
        for b, r in m.items():
            if b == UNDATED:
                if since_us is None:
                    whole[b] = r["version"]
            elif r["high_us"] <= as_of_us and (since_us is None or since_us <= month_start(b)):
                whole[b] = r["version"]
        edges = [b for b in m if b not in whole and b != UNDATED and month_start(b) <= as_of_us and (since_us is None or since_us < month_start(b + 1))]
        parts = self._stored(whole)
        if edges:
            e = self._events(events).filter(F.col("bucket").isin(edges) & (F.col("at_us") <= as_of_us) & (F.lit(since_us is None) | (F.col("at_us") >= F.lit(since_us or 0))))
            parts = parts.unionByName(_partials(e))
        per = parts.groupBy("entity", "type").agg(F.sum("n").alias("n"), F.sum("n_amounts").alias("n_amounts"), F.sum("total").alias("total"), (F.lit(as_of_us) - F.max("last_us")).alias("recency_us"))
        return per.groupBy("entity").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"), F.array_sort(F.collect_list(F.struct("type", "n", "n_amounts", "total", "recency_us"))).alias("types")
        )
