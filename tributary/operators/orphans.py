"""References to records that do not exist (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.keys import all_salts, salt
from tributary.storage import written

#: A key is hot from this share of the references; so at most 1 / HOT_SHARE keys are.
HOT_SHARE, SALTS = 0.01, 32


def deleted_spans(history: DataFrame) -> DataFrame:
    """(key, since, until) in which a record was deleted, of ``history`` (key, at, version, gone).

    The last row up to a moment, by at, then version, says whether the record is gone. until is null for a span that still lasts. Rows without a moment say
    nothing. The row behind each one is looked for within its day first, then among the first rows of the key's later days: a key with very many rows is
    spread over tasks by day, and the window over its days is bounded by the calendar.
    """
    rows = history.select("key", "at", "version", "gone").filter(F.col("key").isNotNull() & F.col("at").isNotNull()).withColumn("day", F.to_date("at"))
    within = F.lead("at").over(Window.partitionBy("key", "day").orderBy("at", F.col("version").asc_nulls_first()))
    gone = rows.withColumn("next", within).filter("gone")
    days = rows.groupBy("key", "day").agg(F.min("at").alias("head"))
    days = days.withColumn("after", F.lead("head").over(Window.partitionBy("key").orderBy("day"))).select("key", "day", "after")
    ends = gone.join(days, ["key", "day"], "left").withColumn("until", F.coalesce("next", "after"))
    return ends.filter(F.col("until").isNull() | (F.col("until") > F.col("at"))).select("key", F.col("at").alias("since"), "until")


def orphans(child: DataFrame, parents: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Rows of ``child`` (src, row_id, ref, at) whose reference did not hold at their moment, with orphan_kind.

    ``parents`` (key, at) has the moments at which the records referred to were loaded. missing: no such key, found by an anti-join of the distinct references
    with the distinct keys; late: all its rows came after this row; deleted: the row falls into a span of ``deleted`` (key, since, until).
    The distinct references carry the range of their rows' moments, so only keys that really have an orphan are joined back to the rows, and rows of hot keys
    are salted for that. Null references are no orphans; a row without a moment can only be missing; a parent row without a moment counts as loaded before
    all else. Rows that are repeated come out repeated. Empty tables: without parents every reference is missing, without children there is no result.
    """
    child = child.select("src", "row_id", "ref", "at")
    refs = written(
        child.filter(F.col("ref").isNotNull()).groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high")), "refs"
    )
    first = parents.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("at").alias("first"), F.bool_or(F.col("at").isNull()).alias("always"))
    none = F.lit(None).cast(child.schema["at"].dataType)
    keys = first.withColumnRenamed("key", "ref")
    spans = refs.join(keys.select("ref"), "ref", "left_anti").select("ref", none.alias("since"), none.alias("until"), F.lit("missing").alias("orphan_kind"))
    late = refs.join(keys.filter(~F.col("always")), "ref").filter(F.col("low") < F.col("first"))
    spans = spans.unionByName(late.select("ref", none.alias("since"), F.col("first").alias("until"), F.lit("late").alias("orphan_kind")))
    if deleted is not None:
        gone = refs.join(deleted.withColumnRenamed("key", "ref"), "ref")
        gone = gone.filter((F.col("high") >= F.col("since")) & (F.col("until").isNull() | (F.col("low") < F.col("until"))))
        spans = spans.unionByName(gone.select("ref", "since", "until", F.lit("deleted").alias("orphan_kind")))
    total = refs.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in refs.filter(F.col("n") > HOT_SHARE * total).select("ref").collect()]
    c = child.filter(F.col("ref").isNotNull()).withColumn("__salt", salt(F.col("ref"), hot, SALTS, "row_id", "at")).alias("c")
    s = spans.withColumn("__salt", F.explode(all_salts(F.col("ref"), hot, SALTS))).alias("s")
    holds = (F.col("s.orphan_kind") == "missing") | (
        (F.col("s.since").isNull() | (F.col("c.at") >= F.col("s.since"))) & (F.col("s.until").isNull() | (F.col("c.at") < F.col("s.until"))) & F.col("c.at").isNotNull()
    )
    on = (F.col("c.ref") == F.col("s.ref")) & (F.col("c.__salt") == F.col("s.__salt")) & holds
    return c.join(s, on).select("c.src", "c.row_id", "c.ref", "c.at", "s.orphan_kind")


def report(found: DataFrame) -> DataFrame:
    """Orphans per table, kind and month."""
    return found.groupBy("src", "orphan_kind", F.date_format("at", "yyyy-MM").alias("month_utc")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ref").alias("n_keys"))
