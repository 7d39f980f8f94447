"""Scalar functions that the session lacks under the names queries use, as SQL functions, which the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, type, body)
FUNCTIONS = {
    "strpos": ("s STRING, sub STRING", "INT", "locate(sub, s)"),
    "starts_with": ("s STRING, p STRING", "BOOLEAN", "startswith(s, p)"),
    "ends_with": ("s STRING, p STRING", "BOOLEAN", "endswith(s, p)"),
    "to_hex": ("n BIGINT", "STRING", "lower(hex(n))"),
    "sha224": ("s STRING", "STRING", "sha2(s, 224)"),
    "sha256": ("s STRING", "STRING", "sha2(s, 256)"),
    "sha384": ("s STRING", "STRING", "sha2(s, 384)"),
    "sha512": ("s STRING", "STRING", "sha2(s, 512)"),
    "regexp_match": ("s STRING, p STRING", "ARRAY<STRING>", "CASE WHEN s RLIKE p THEN array(regexp_extract(s, concat('(', p, ')'), 1)) END"),
    "iszero": ("x DOUBLE", "BOOLEAN", "x = 0"),
    "nanvl_": ("a DOUBLE, b DOUBLE", "DOUBLE", "nanvl(a, b)"),
    "trunc_num": ("x DOUBLE, d INT", "DOUBLE", "signum(x) * floor(abs(x) * power(10, d)) / power(10, d)"),
    "date_bin": ("seconds BIGINT, t TIMESTAMP_NTZ, origin TIMESTAMP_NTZ", "TIMESTAMP_NTZ",
                 "origin + make_dt_interval(0, 0, 0, floor(timestampdiff(MICROSECOND, origin, t) / (seconds * 1000000D)) * seconds)"),
    "string_to_array": ("s STRING, sep STRING", "ARRAY<STRING>", "split(s, concat('\\\\Q', sep, '\\\\E'))"),
}


def register(spark: SparkSession) -> None:
    """Define the functions in this session. Names that the session has built in are left alone."""
    for name, (params, kind, body) in FUNCTIONS.items():
        if not spark.catalog.functionExists(name):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
