"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that decide results (dialect, zone) or let the planner adapt at run time.
CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tributary", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app).config(map=CONF | {k.replace("__", "."): v for k, v in conf.items()})
    return (b.master(master) if master else b).getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable part of CONF to a session made elsewhere."""
    for k, v in CONF.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    return spark
