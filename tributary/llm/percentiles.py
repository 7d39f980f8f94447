"""Exact percentiles per group by narrowing value intervals (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.storage import written

#: Parts into which a pass cuts every open interval: it counts the rows below PARTS - 1 inner points at once, which a plain bisection would take log2(PARTS) passes for.
PARTS = 4096
#: Slices of the values of every group, by a hash, that meet its intervals in different tasks.
SLICES = 8
_MAX = 1.7976931348623157e308


def piece(rows: DataFrame) -> DataFrame:
    """Mergeable piece of ``rows`` (grp, value): (grp, value, n), the count of each number; pieces of separate days or partitions are put together by ``merge``.

    Null and NaN values are left out, -0.0 counts as 0.0, infinite values as the largest finite ones; a null group is a group. Equal values become one row,
    so no later step sees a hot value.
    """
    v = F.col("value").cast("double")
    v = F.greatest(F.least(v, F.lit(_MAX)), F.lit(-_MAX)) + F.lit(0.0)
    return rows.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).groupBy("grp", v.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merge(*pieces: DataFrame) -> DataFrame:
    """One piece of several."""
    first, *rest = pieces
    for p in rest:
        first = first.unionByName(p)
    return first.groupBy("grp", "value").agg(F.sum("n").alias("n"))


def _scale(c: F.Column) -> F.Column:
    """A rising function of a double that is even in its logarithm, down to the least numbers there are: 0 lies in the middle, all else within 1,456 of it."""
    return F.when(c == 0, F.lit(0.0)).otherwise(F.signum(c) * (F.ln(F.abs(c)) + 746))


def _bucket() -> F.Column:
    """Part of the interval [low, high] that a value lies in, never falling as the value rises; the ends lie in different parts."""
    v, lo, hi = F.col("value"), F.col("low"), F.col("high")
    wide = _scale(hi) - _scale(lo)
    log = (_scale(v) - _scale(lo)) / wide
    line = (v * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5)
    at = F.least(F.floor(F.when(wide > 1e-3, log).otherwise(line) * PARTS), F.lit(PARTS - 1)).cast("int")
    return F.when(v == hi, F.lit(PARTS)).otherwise(at)


def percentiles(pieces: DataFrame, points: dict[str, int]) -> DataFrame:
    """(grp, n, and a column per point): the value of rank ceil(p * n) of each group, exact, so the error is 0; ``points`` gives p in hundredths of a percent.

    For every group and point an interval of values that holds the target rank is kept. Each pass counts the rows in PARTS parts of every open interval, with
    the least and greatest value of each part, and narrows to the part that holds the rank, until the interval is one value. Ends are values that occur and lie
    in different parts, so every pass narrows; parts are even on a logarithmic scale of all doubles first and on a linear one later, and each pass divides the
    scale by PARTS, so 7 passes or fewer reach any double. Counts are additive over pieces. The state has one row per group and point and stays distributed;
    only the number of open intervals comes to the driver. A group with very many values is cut into SLICES for the join. Empty in, empty out.
    """
    every = written(pieces, "piece")
    stats = every.groupBy("grp").agg(F.sum("n").alias("size"), F.min("value").alias("low"), F.max("value").alias("high"))
    targets = F.explode(F.array(*[F.struct(F.lit(k).alias("point"), F.lit(bp).cast("bigint").alias("bp")) for k, bp in points.items()])).alias("t")
    state = stats.select("grp", "size", "low", "high", targets, F.lit(0).cast("bigint").alias("below"))
    state = state.select("grp", "size", "low", "high", "below", "t.point", F.greatest(F.lit(1), F.expr("(t.bp * size + 9999) div 10000")).alias("rank"))
    state = written(state, "intervals")
    sliced = every.withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(SLICES)).cast("int"))
    while state.filter("low < high").limit(1).count():
        open_ = state.filter("low < high").select(F.col("grp").alias("g"), "low", "high").distinct()
        open_ = open_.select("*", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("s"))
        inside = sliced.join(open_, F.col("grp").eqNullSafe(F.col("g")) & (F.col("slice") == F.col("s")) & F.col("value").between(F.col("low"), F.col("high")))
        part = inside.groupBy("g", "low", "high", _bucket().alias("part")).agg(F.sum("n").alias("held"), F.min("value").alias("new_low"), F.max("value").alias("new_high"))
        upto = F.sum("held").over(Window.partitionBy("g", "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        part = part.withColumn("upto", upto).withColumnsRenamed({"low": "l", "high": "h"})
        holds = (
            F.col("grp").eqNullSafe(F.col("g")) & (F.col("low") == F.col("l")) & (F.col("high") == F.col("h"))
            & (F.col("rank") - F.col("below") <= F.col("upto")) & (F.col("rank") - F.col("below") > F.col("upto") - F.col("held"))
        )
        keep = ["grp", "size", "low", "high", "below", "point", "rank"]
        moved = state.filter("low < high").join(part, holds)
        moved = moved.select("grp", "size", F.col("new_low").alias("low"), F.col("new_high").alias("high"), (F.col("below") + F.col("upto") - F.col("held")).alias("below"), "point", "rank")
        state = written(state.filter("low >= high").select(keep).unionByName(moved.select(keep)), "intervals")
    return state.groupBy("grp").agg(F.first("size").alias("n"), *[F.max(F.when(F.col("point") == k, F.col("low"))).alias(k) for k in points])
