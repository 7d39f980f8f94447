"""Declared column types and the lenient reading of JSON cells into them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of column types; any other spelling is text.
TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "int32": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(), "int64": T.LongType(),
    "long": T.LongType(), "float": T.FloatType(), "float32": T.FloatType(), "double": T.DoubleType(), "float64": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
}


def spark_type(name: str) -> T.DataType:
    return TYPES.get(name.lower(), T.StringType())


def struct_of(schema: list[dict]) -> T.StructType:
    """[{name, type}] as a schema of nullable columns."""
    return T.StructType([T.StructField(c["name"], spark_type(c.get("type", "varchar"))) for c in schema])


def json_cell(cell: Column, kind: str) -> Column:
    """A variant cell as the declared type, null where it can't be: integers take whole numbers, numbers cut off toward zero and digits as text; doubles also
    take text; text keeps strings as they are and any other value as compact JSON; json is the JSON text."""
    t, shape = spark_type(kind), F.schema_of_variant(cell)
    text = F.when(shape == "STRING", F.try_variant_get(cell, "$", "string"))
    number = F.when((shape == "BIGINT") | (shape == "DOUBLE") | shape.startswith("DECIMAL"), F.try_variant_get(cell, "$", "double"))
    if isinstance(t, (T.IntegerType, T.LongType)):
        low, high = (-(2**31), 2**31 - 1) if isinstance(t, T.IntegerType) else (-(2**63), 2**63 - 1)
        whole = F.coalesce(F.when(shape == "BIGINT", F.try_variant_get(cell, "$", "bigint")), F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("bigint")))
        cut = F.when(number.isNotNull(), F.when(number >= 2.0**63, F.lit(2**63 - 1)).when(number <= -(2.0**63), F.lit(-(2**63))).otherwise(number.try_cast("bigint")))
        v = F.coalesce(whole, cut)
        return v if isinstance(t, T.LongType) else F.when((v >= low) & (v <= high), v.try_cast("int"))
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.coalesce(number, F.trim(text).try_cast("double")).cast(t)
    if isinstance(t, T.BooleanType):
        return F.coalesce(F.when(shape == "BOOLEAN", F.try_variant_get(cell, "$", "boolean")), F.when(F.lower(text).isin("true", "false"), F.lower(text).try_cast("boolean")))
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return text.try_cast(t)
    present = cell.isNotNull() & (shape != "VOID")
    return F.when(present, F.to_json(cell)) if kind.lower() == "json" else F.when(present, F.coalesce(text, F.to_json(cell)))
