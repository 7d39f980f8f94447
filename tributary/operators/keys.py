"""Text keys, current rows and hot keys: small pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space that surrounds untidy keys.
WHITE = " \t\n\r\x0b\x0c\x85\xa0  　﻿"


def clean_key(name: str | Column) -> Column:
    """A text key without surrounding white space, in lower case; null stays null and blank becomes ''."""
    return F.lower(F.btrim(F.col(name) if isinstance(name, str) else name, F.lit(WHITE)))


def number(name: str) -> Column:
    """A double with NaN as null and -0.0 as 0.0, so that equal numbers are equal keys."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c + F.lit(0.0))


def day_of(us: str) -> Column:
    """UTC day since 1970 of microseconds since then, in whole numbers, so exact for any of them."""
    return F.expr(f"CAST((`{us}` - pmod(`{us}`, 86400000000)) DIV 86400000000 AS INT)")


def current_rows(df: DataFrame, key: str, order: list[str], *keep: str) -> DataFrame:
    """The row of each ``key`` that is greatest by ``order`` (nulls least), with the columns ``keep``.

    A null key names no record, so each such row is current. Rows that tie in all of ``order`` differ in nothing that counts here; one of them is kept.
    Rows without a key get a number of their own as key, so they spread over tasks and the table is read once.
    The window's row limit runs before the shuffle as well, so repeats of one hot key are cut down where they are read.
    """
    cols = list(dict.fromkeys([key, *order, *keep]))
    rows = df.select(*cols).withColumn("__own", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    w = Window.partitionBy(key, "__own").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*keep)


def hot_values(df: DataFrame, columns: list[str], share: float = 0.01) -> dict[str, list]:
    """For each column the values that hold at least about ``share`` of the rows, so never more than 1 / share of them; from one pass with frequent-items
    sketches of fixed size."""
    most = int(1 / share)
    found = df.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"approx_top_k(`{c}`, {most}, {most * 100}) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"top{k}") for k, c in enumerate(columns)]).first()
    return {c: [x["item"] for x in found[f"top{k}"] or [] if x["item"] is not None and x["count"] >= share * found["n"]] for k, c in enumerate(columns)}


def salt(key: Column, hot: list, pieces: int, *row: str) -> Column:
    """0 for most rows; for rows of a hot key a number below ``pieces`` drawn from a hash of the row's columns, the same again when a task is retried."""
    return F.when(key.isin(hot), F.pmod(F.xxhash64(*row), F.lit(pieces)).cast("int")).otherwise(F.lit(0)) if hot else F.lit(0)


def all_salts(key: Column, hot: list, pieces: int) -> Column:
    """The array of salts that rows of ``key`` can have, for the other side of a salted join."""
    return F.when(key.isin(hot), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
