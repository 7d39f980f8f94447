"""Top N items within every group by descending score bands (problem 3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.storage import written

#: Shares of all rows above the lower edge of each band but the last, which takes the rest.
BANDS = (0.02, 0.15)
#: Most bytes of keys of filled groups that are broadcast, measured before each broadcast.
BROADCAST_BYTES = 16 << 20


def band_edges(rows: DataFrame, score: str, shares: tuple[float, ...] = BANDS) -> list[float]:
    """Scores above which about those shares of the rows lie, from a sketch of fixed size; a rough edge costs time, never a row."""
    found = rows.agg(F.percentile_approx(score, [1 - s for s in shares], 1000).alias("e")).first()["e"]
    return sorted({x for x in found or [] if x == x}, reverse=True)


def top_n(rows: DataFrame, n: int, keep: list[str], edges: list[float]) -> DataFrame:
    """Rows of ``rows`` (grp, score, tie and ``keep``) among the first ``n`` of their group, with rank_no from 1 by score descending, then tie ascending.

    Rows with a null group, or a null or NaN score, take no part; a null tie comes last. Rows that tie in both score and tie are ranked in an order that
    isn't defined; callers who need one make tie unique. Other columns of ``rows`` are left out. The rows are written once, in bands of descending score with the lower ``edges``. Each band is
    read from the top without the groups that the bands above have filled, and its first rows per group are ranked exactly, behind the rows that the group has
    from above. The ranking window cuts every task's rows to n per group before the shuffle, so a group of any size sends no more than n rows a task. The
    filled groups' keys are broadcast where their measured size is at most BROADCAST_BYTES; beyond that the anti-join follows the cut, where no group is large and
    the rows already lie by group. Either way gives the same rows. Empty tables give no rows.
    """
    cols = list(dict.fromkeys(["grp", "score", "tie", *keep]))
    valid = rows.select(*cols).filter(F.col("grp").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")).withColumn("score", F.col("score") + F.lit(0.0))
    band = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        band = F.when(F.col("score") >= F.lit(edges[k]), F.lit(k)).otherwise(band)
    banded = written(valid.withColumn("__band", band), "bands", "__band")
    w = Window.partitionBy("grp").orderBy(F.col("score").desc(), F.col("tie").asc_nulls_last())
    done: list[DataFrame] = []
    for k in range(len(edges) + 1):
        part = banded.filter(F.col("__band") == k).drop("__band")
        if done:
            have = reduce(DataFrame.unionAll, [x.select("grp") for x in done]).groupBy("grp").agg(F.count(F.lit(1)).cast("int").alias("__have"))
            filled = have.filter(F.col("__have") >= n).select("grp")
            size = filled.agg(F.sum(F.octet_length(F.col("grp").cast("string")) + 32)).first()[0] or 0  # a row's own bytes besides
            small = size <= BROADCAST_BYTES
            if small:
                part = part.join(F.broadcast(filled), "grp", "left_anti")
        first = part.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n)
        if done:
            if not small:
                first = first.join(filled, "grp", "left_anti")
            first = first.join(have, "grp", "left").withColumn("__rank", F.col("__rank") + F.coalesce("__have", F.lit(0))).filter(F.col("__rank") <= n).drop("__have")
        done.append(written(first, "top") if k < len(edges) else first)
    return reduce(DataFrame.unionByName, done).select(*keep, F.col("__rank").alias("rank_no"))
