"""Problems 8, 9 and 10 over documents."""

import os

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import bpe, leakage, pii
from tributary.queries.tables import table

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("TRIBUTARY_TOKENIZERS", "/opt/tokenizers")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id", spans=True)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_values(table(spark, d, "documents"), "doc_id").select("doc_id", "pii_kind", "found_text").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"), "doc_id")


QUERIES = {"p8_ids": p8_ids, "p9_found": p9_found, "p9_passages": p9_passages, "p10_found": p10_found, "p10_redacted": p10_redacted}
ORACLE: dict = {}
