"""JSON helpers over text columns, as Column builders that stay inside the JVM.

Paths are dotted object keys for ``extract_string`` and keys or array indexes for the typed getters. Bad JSON, a missing path and a value of another type
give null; nothing here raises.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _node(col: Column, keys: tuple[str | int, ...]) -> Column:
    """The variant at a path; keys that no path can spell, with quotes or brackets in them, are looked up in the object as a map."""
    v = F.try_parse_json(col)
    for k in keys:
        if isinstance(k, int) or re.fullmatch(r"[\w $@#%&*+,;:<>=~|/!^()-]+", k):
            v = F.try_variant_get(v, f"$[{k}]" if isinstance(k, int) else f'$["{k}"]', "variant")
        else:
            v = F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(k))
    return v


def _kind(node: Column) -> Column:
    return F.schema_of_variant(node)


def elements(col: Column) -> Column:
    """Array elements as texts, strings unquoted and null as 'null'; any other value is the only element; bad JSON and null give null."""
    node = F.try_parse_json(col)
    raw = F.from_json(F.concat(F.lit('{"a":'), col, F.lit("}")), "a array<variant>")["a"]
    texts = F.transform(raw, lambda x: F.when(x.isNull() | (F.schema_of_variant(x) == "VOID"), F.lit("null")).otherwise(text_of(x)))
    return F.when(node.isNotNull(), F.when(F.ltrim(col).startswith("["), texts).otherwise(F.array(F.coalesce(text_of(node), F.lit("null")))))


def text_of(node: Column) -> Column:
    """A string without quotes, any other value as compact JSON."""
    return F.when(_kind(node) == "STRING", F.try_variant_get(node, "$", "string")).otherwise(F.to_json(node))


def extract_string(col: Column, path: str) -> Column:
    """Text at a dotted path of object keys; JSON null, a missing key and array steps give null."""
    node = _node(col, tuple(path.split(".")))
    return F.when(node.isNotNull() & (_kind(node) != "VOID"), text_of(node))


def get_str(col: Column, *keys: str | int) -> Column:
    node = _node(col, keys)
    return F.when(_kind(node) == "STRING", F.try_variant_get(node, "$", "string"))


def get_int(col: Column, *keys: str | int) -> Column:
    node = _node(col, keys)
    return F.when(_kind(node) == "BIGINT", F.try_variant_get(node, "$", "bigint"))


def get_float(col: Column, *keys: str | int) -> Column:
    """A JSON number as a double; a number written as a string is null."""
    node = _node(col, keys)
    return F.when((_kind(node) == "BIGINT") | (_kind(node) == "DOUBLE") | _kind(node).startswith("DECIMAL"), F.try_variant_get(node, "$", "double"))


def get_bool(col: Column, *keys: str | int) -> Column:
    node = _node(col, keys)
    return F.when(_kind(node) == "BOOLEAN", F.try_variant_get(node, "$", "boolean"))


def get_json(col: Column, *keys: str | int) -> Column:
    """The value as JSON text, strings in quotes."""
    return F.to_json(_node(col, keys))


def get_array(col: Column, *keys: str | int) -> Column:
    """The elements of an array as texts of JSON; null for any other value."""
    j = get_json(col, *keys)
    return F.when(j.startswith("["), F.transform(F.from_json(F.concat(F.lit('{"a":'), j, F.lit("}")), "a array<variant>")["a"], lambda x: F.coalesce(F.to_json(x), F.lit("null"))))


def length(col: Column, *keys: str | int) -> Column:
    """Elements of an array or keys of an object; null for any other value."""
    j = get_json(col, *keys)
    return F.coalesce(F.json_array_length(j), F.when(j.startswith("{"), F.size(F.json_object_keys(j)))).cast("bigint")


def contains(col: Column, *keys: str | int) -> Column:
    """Whether the path exists; a JSON null is there, bad JSON and null text give false."""
    return F.coalesce(_node(col, keys).isNotNull(), F.lit(False))


def object_keys(col: Column, *keys: str | int) -> Column:
    j = get_json(col, *keys)
    return F.when(j.startswith("{"), F.json_object_keys(j))
