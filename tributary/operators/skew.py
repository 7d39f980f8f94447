"""Per-key results where a few keys hold most rows (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.keys import hot_values, salt

#: Share of the rows from which a key is salted, and the number of salts.
HOT_SHARE, SALTS = 0.005, 64


def salted_totals(df: DataFrame, keys: dict[str, Column], amount: str, row: list[str]) -> DataFrame:
    """(field_name, key, n_rows, n_amounts, total): rows, amounts that are numbers, and their sum, of each value of each of ``keys``; in two stages.

    One pass over the table finds the hot values of all keys by sketches of fixed size, a second one aggregates. Rows of hot values get a salt from the columns
    ``row``; the first stage aggregates by key and salt, the second by key. So no task gets all rows of a hot value, whatever the aggregate. A null key is a
    key of its own; null and NaN amounts count as rows only; infinite ones are summed; an empty table gives no rows.
    """
    hot = hot_values(df.select(*[c.alias(n) for n, c in keys.items()]), list(keys), HOT_SHARE)
    value: Column = F.when(~F.isnan(F.col(amount)), F.col(amount))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), c.alias("key"), salt(c, hot[n], SALTS, *row).alias("salt")) for n, c in keys.items()]))
    first = (
        df.select(value.alias("value"), each.alias("k")).groupBy("k.field_name", "k.key", "k.salt")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_amounts"), F.sum("value").alias("total"))
    )
    return first.groupBy("field_name", "key").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_amounts").alias("n_amounts"), F.sum("total").alias("total"))


def frequent(totals: DataFrame, share: float) -> DataFrame:
    """Keys, not null, of at least ``share`` of all rows; every row counts once for each field, so a field's sum of rows is the table's."""
    rows = totals.groupBy("field_name").agg(F.sum("n_rows").alias("all_rows"))
    return totals.join(F.broadcast(rows), "field_name").filter(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("all_rows")))
