"""Functions of free SQL that Spark has under another name or not at all, as rewrites of their calls: a macro gets the texts of the arguments and gives Spark SQL.

A rewrite, unlike a SQL function, works for arrays and maps of any type and for any number of arguments, and leaves nothing but built-in expressions for the
optimizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from tributary.errors import EngineError

Macro = Callable[[list[str]], str]


def literal(text: str) -> str | int | None:
    """The value of a text or integer literal, None for any other expression."""
    t = text.strip()
    if re.fullmatch(r"'(?:[^']|'')*'", t):
        return t[1:-1].replace("''", "'")
    return int(t) if re.fullmatch(r"-?\d+", t) else None


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- JSON ------------------------------------------------------------------------------------------------------------------------------------------------


def json_node(column: str, keys: list[str | int]) -> str:
    """The variant at a path of object keys and array indexes. Keys that no path can spell are looked up in the object as a map."""
    node, path = f"try_parse_json({column})", ""
    for k in keys:
        if isinstance(k, int):
            path += f"[{k}]"
        elif re.fullmatch(r"[\w $@#%&*+,;:<>=~|/!^()-]+", k):
            path += f'["{k}"]'
        else:
            if path:
                node, path = f"try_variant_get({node}, {quoted('$' + path)}, 'variant')", ""
            node = f"try_element_at(try_variant_get({node}, '$', 'map<string,variant>'), {quoted(k)})"
    return f"try_variant_get({node}, {quoted('$' + path)}, 'variant')" if path else node


def _path(args: list[str], name: str) -> tuple[str, list[str | int]]:
    keys = [literal(a) for a in args[1:]]
    if not args or any(k is None for k in keys):
        raise EngineError("INVALID_ARGUMENT", f"{name} takes a JSON text and keys or indexes that are literals")
    return args[0], keys


def _typed(name: str, kind: str, test: str) -> Macro:
    def macro(args: list[str]) -> str:
        node = json_node(*_path(args, name))
        return f"(CASE WHEN schema_of_variant({node}) {test} THEN try_variant_get({node}, '$', '{kind}') END)"

    return macro


def _json_json(args: list[str]) -> str:
    return f"to_json({json_node(*_path(args, 'json_get_json'))})"


def _json_array(args: list[str]) -> str:
    return f"transform(try_variant_get({json_node(*_path(args, 'json_get_array'))}, '$', 'array<variant>'), __x -> coalesce(to_json(__x), 'null'))"


def _json_length(args: list[str]) -> str:
    j = _json_json(args)
    return f"CAST(coalesce(json_array_length({j}), CASE WHEN {j} LIKE '{{%' THEN size(json_object_keys({j})) END) AS BIGINT)"


def _json_keys(args: list[str]) -> str:
    j = _json_json(args)
    return f"(CASE WHEN {j} LIKE '{{%' THEN json_object_keys({j}) END)"


def _json_extract(args: list[str]) -> str:
    path = literal(args[1]) if len(args) == 2 else None
    if not isinstance(path, str):
        raise EngineError("INVALID_ARGUMENT", "json_extract_string takes a JSON text and a dotted path that is a literal")
    node = json_node(args[0], list(path.split(".")))
    return f"(CASE schema_of_variant({node}) WHEN 'VOID' THEN NULL WHEN 'STRING' THEN try_variant_get({node}, '$', 'string') ELSE to_json({node}) END)"


def _elements(args: list[str]) -> str:
    """from_json of one argument: an array's elements as texts, any other value as the only element."""
    if len(args) != 1:
        return f"from_json({', '.join(args)})"
    node = f"try_parse_json({args[0]})"
    text = "CASE WHEN {0} IS NULL OR schema_of_variant({0}) = 'VOID' THEN 'null' WHEN schema_of_variant({0}) = 'STRING' THEN try_variant_get({0}, '$', 'string') ELSE to_json({0}) END"
    return f"(CASE WHEN {node} IS NULL THEN NULL WHEN ltrim({args[0]}) LIKE '[%' THEN transform(try_variant_get({node}, '$', 'array<variant>'), __x -> {text.format('__x')}) ELSE array({text.format(node)}) END)"


# --- arrays and others -----------------------------------------------------------------------------------------------------------------------------------


def _nth(a: str, x: str, n: str) -> str:
    """Whether __e at place __i of ``a`` is one of the first n elements equal to x."""
    return f"(__e <=> {x} AND size(filter(slice({a}, 1, __i + 1), __y -> __y <=> {x})) <= {n})"


def _remove(args: list[str]) -> str:
    a, x, n = args[0], args[1], args[2] if len(args) > 2 else "1"
    return f"filter({a}, (__e, __i) -> NOT {_nth(a, x, n)})"


def _replace(args: list[str]) -> str:
    a, x, to, n = args[0], args[1], args[2], args[3] if len(args) > 3 else "1"
    return f"transform({a}, (__e, __i) -> CASE WHEN {_nth(a, x, n)} THEN {to} ELSE __e END)"


def _slice(args: list[str]) -> str:
    a, low, high = args[:3]
    place = lambda k, least: f"(CASE WHEN {k} < 0 THEN size({a}) + {k} + 1 ELSE greatest({k}, {least}) END)"
    out = f"slice({a}, greatest({place(low, 1)}, 1), greatest(least({place(high, 0)}, size({a})) - greatest({place(low, 1)}, 1) + 1, 0))"
    return out if len(args) < 4 else f"filter({out}, (__e, __i) -> __i % ({args[3]}) = 0)"


def _moment(make: str) -> Macro:
    def macro(args: list[str]) -> str:
        x = args[0]
        whole = f"try_cast(CAST({x} AS STRING) AS BIGINT)"
        return f"CAST(coalesce({make.format(whole)}, try_to_timestamp(CAST({x} AS STRING))) AS TIMESTAMP_NTZ)"

    return macro


# Letters of date patterns and the same in Java's.
_PATTERN = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "%"}
# Type names of arrow_cast and the same in Spark.
_TYPES = {
    "Int8": "TINYINT", "Int16": "SMALLINT", "Int32": "INT", "Int64": "BIGINT", "UInt8": "SMALLINT", "UInt16": "INT", "UInt32": "BIGINT", "UInt64": "DECIMAL(20,0)", "Float32": "FLOAT", "Float64": "DOUBLE",
    "Boolean": "BOOLEAN", "Utf8": "STRING", "LargeUtf8": "STRING", "Utf8View": "STRING", "Binary": "BINARY", "LargeBinary": "BINARY", "Date32": "DATE", "Date64": "DATE",
}


def _pattern(args: list[str], name: str) -> str:
    p = literal(args[1]) if len(args) == 2 else None
    if isinstance(p, str) and "%" in p:
        p = re.sub(r"%(.)|([A-Za-z]+)", lambda m: _PATTERN.get(m[1], m[1]) if m[1] else f"'{m[2]}'", p)
        return f"date_format({args[0]}, {quoted(p)})"
    return f"{name}({', '.join(args)})"


def _arrow_cast(args: list[str]) -> str:
    kind = literal(args[1])
    to = _TYPES.get(str(kind)) or ("TIMESTAMP_NTZ" if str(kind).startswith("Timestamp") else f"DECIMAL({m[1]})" if (m := re.match(r"Decimal\d+\((.*)\)", str(kind))) else None)
    if not to:
        raise EngineError("INVALID_ARGUMENT", f"no type {kind!r}")
    return f"CAST({args[0]} AS {to})"


def _arrow_typeof(args: list[str]) -> str:
    back = {v.lower(): k for k, v in reversed(_TYPES.items())} | {"timestamp_ntz": "Timestamp(Microsecond, None)"}
    return f"(CASE typeof({args[0]}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in back.items()) + f" ELSE typeof({args[0]}) END)"


def _digest(args: list[str]) -> str:
    how = str(literal(args[1])).lower()
    if how not in ("md5", "sha224", "sha256", "sha384", "sha512"):
        raise EngineError("INVALID_ARGUMENT", f"no digest {how!r}")
    return f"unhex({'md5(' + args[0] + ')' if how == 'md5' else 'sha2(' + args[0] + ', ' + how[3:] + ')'})"


def _trunc(args: list[str]) -> str:
    if len(args) == 2 and not isinstance(literal(args[1]), int):
        return f"trunc({', '.join(args)})"
    return f"trunc_num({args[0]}, {args[1] if len(args) == 2 else '0'})"


def _range(args: list[str]) -> str:
    low, high, step = ("0", args[0], "1") if len(args) == 1 else (args[0], args[1], args[2] if len(args) > 2 else "1")
    return f"filter(sequence({low}, {high}, CASE WHEN {high} >= {low} THEN abs({step}) ELSE -abs({step}) END), __x -> CASE WHEN ({step}) > 0 THEN __x < {high} ELSE __x > {high} END)"


def _to(pattern: str) -> Macro:
    return lambda args: pattern.format(*args, all=", ".join(args))


_GCD = "aggregate(sequence(1, 92), struct(abs(CAST({0} AS BIGINT)) AS x, abs(CAST({1} AS BIGINT)) AS y), (__s, __i) -> CASE WHEN __s.y = 0 THEN __s ELSE struct(__s.y AS x, __s.x % __s.y AS y) END, __s -> __s.x)"
MACROS: dict[str, Macro] = {
    "from_json": _elements, "json_elements": _elements,
    "json_get": _json_json, "json_get_json": _json_json, "json_get_array": _json_array, "json_length": _json_length, "json_object_keys": _json_keys, "json_extract_string": _json_extract,
    "json_get_str": _typed("json_get_str", "string", "= 'STRING'"), "json_get_int": _typed("json_get_int", "bigint", "= 'BIGINT'"), "json_get_bool": _typed("json_get_bool", "boolean", "= 'BOOLEAN'"),
    "json_get_float": _typed("json_get_float", "double", "RLIKE '^(BIGINT|DOUBLE|DECIMAL)'"),
    "json_contains": lambda args: f"coalesce(({json_node(*_path(args, 'json_contains'))}) IS NOT NULL, false)",
    "substr_index": _to("substring_index({all})"), "digest": _digest, "trunc": _trunc, "range": _range, "gcd": _to(_GCD),
    "lcm": _to("(CASE WHEN {0} = 0 OR {1} = 0 THEN 0 ELSE abs(CAST({0} AS BIGINT) * (CAST({1} AS BIGINT) DIV " + _GCD + ")) END)"),
    "to_local_time": _to("CAST({0} AS TIMESTAMP_NTZ)"), "to_timestamp_seconds": _moment("timestamp_seconds({0})"), "to_timestamp_millis": _moment("timestamp_millis({0})"), "to_timestamp_micros": _moment("timestamp_micros({0})"),
    "to_timestamp_nanos": _moment("timestamp_micros({0} DIV 1000)"), "to_unixtime": _to("unix_seconds(CAST({0} AS TIMESTAMP))"), "to_char": lambda args: _pattern(args, "to_char"), "date_format": lambda args: _pattern(args, "date_format"),
    "make_array": _to("array({all})"), "array_concat": _to("concat({all})"), "array_cat": _to("concat({all})"), "list_concat": _to("concat({all})"), "array_has": _to("array_contains({all})"), "list_has": _to("array_contains({all})"), "list_contains": _to("array_contains({all})"),
    "array_has_all": _to("(size(array_except({1}, {0})) = 0)"), "array_has_any": _to("arrays_overlap({all})"), "array_element": _to("(CASE WHEN {1} <> 0 THEN try_element_at({0}, CAST({1} AS INT)) END)"),
    "list_element": _to("(CASE WHEN {1} <> 0 THEN try_element_at({0}, CAST({1} AS INT)) END)"), "array_length": _to("(CASE WHEN {0} IS NOT NULL THEN CAST(size({0}) AS BIGINT) END)"), "list_length": _to("(CASE WHEN {0} IS NOT NULL THEN CAST(size({0}) AS BIGINT) END)"),
    "array_positions": _to("(CASE WHEN size({0}) > 0 THEN filter(sequence(1, size({0})), __i -> element_at({0}, __i) <=> {1}) ELSE array() END)"),
    "array_remove": _remove, "array_remove_n": _remove, "array_remove_all": _to("filter({0}, __e -> NOT (__e <=> {1}))"), "array_replace": _replace, "array_replace_n": _replace,
    "array_replace_all": _to("transform({0}, __e -> CASE WHEN __e <=> {1} THEN {2} ELSE __e END)"),
    "array_resize": lambda args: f"(CASE WHEN size({args[0]}) >= {args[1]} THEN slice({args[0]}, 1, {args[1]}) ELSE concat({args[0]}, array_repeat({args[2] if len(args) > 2 else 'NULL'}, CAST({args[1]} AS INT) - size({args[0]}))) END)",
    "array_reverse": _to("reverse({0})"), "array_slice": _slice, "array_any_value": _to("try_element_at(filter({0}, __e -> __e IS NOT NULL), 1)"), "array_dims": _to("array(CAST(size({0}) AS BIGINT))"),
    "array_ndims": _to("CAST((length(typeof({0})) - length(replace(typeof({0}), 'array<', ''))) / 6 AS BIGINT)"),
    "array_distance": _to("sqrt(aggregate(zip_with({0}, {1}, (__x, __y) -> power(CAST(__x AS DOUBLE) - CAST(__y AS DOUBLE), 2)), 0D, (__s, __v) -> __s + __v))"),
    "array_pop_back": _to("slice({0}, 1, greatest(size({0}) - 1, 0))"), "array_pop_front": _to("slice({0}, 2, greatest(size({0}) - 1, 0))"), "empty": _to("(size({0}) = 0)"), "array_to_string": _to("array_join({all})"),
    "get_field": lambda args: f"({args[0]})[{args[1]}]", "row": lambda args: "named_struct(" + ", ".join(f"'c{k}', {a}" for k, a in enumerate(args)) + ")", "make_map": _to("map({all})"),
    "map_extract": _to("(CASE WHEN map_contains_key({0}, {1}) THEN array(try_element_at({0}, {1})) ELSE array() END)"), "arrow_cast": _arrow_cast, "arrow_typeof": _arrow_typeof,
    "approx_distinct": _to("approx_count_distinct({all})"), "approx_median": _to("approx_percentile({0}, 0.5)"), "approx_percentile_cont": _to("approx_percentile({0}, {1})"),
    "approx_percentile_cont_with_weight": _to("percentile({0}, {2}, CAST({1} AS BIGINT))"),
}
