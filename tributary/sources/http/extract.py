"""From a response body to rows: paths, reshaping, columns, computed columns and lenient cells."""

from __future__ import annotations

import base64
import json
import re
from datetime import date, datetime, timedelta, timezone

from tributary.errors import EngineError

_STEP = re.compile(r"\.?([^.\[\]]+)|\[(\d+)\]")


def walk(node, path: str):
    """Value at ``$.a.b[0]`` or ``a.b``; None where a step is missing."""
    for m in _STEP.finditer(path.removeprefix("$")):
        if m[2] is not None:
            node = node[int(m[2])] if isinstance(node, list) and int(m[2]) < len(node) else None
        else:
            node = node.get(m[1]) if isinstance(node, dict) else None
        if node is None:
            return None
    return node


def rows_at(body, path: str = "$", reshape: str | None = None) -> list:
    """An array's elements, a lone object as one row, nothing for null; a scalar is an error.

    dict_entries makes a row of every entry with its key as _key (scalars as _value); series_points one of every [t, v] point with its series' fields.
    """
    node = walk(body, path)
    if node is None:
        return []
    if reshape == "dict_entries":
        if not isinstance(node, dict):
            raise EngineError("SOURCE_SCHEMA_MISMATCH", f"{path} is no object")
        return [{**v, "_key": k} if isinstance(v, dict) else {"_key": k, "_value": v} for k, v in node.items()]
    if reshape == "series_points":
        out = []
        for s in node if isinstance(node, list) else [node]:
            points = s.get("values", s.get("points", []))
            fields = {k: v for k, v in s.items() if k not in ("values", "points")}
            out += [{**fields, "t": p[0], "v": p[1]} for p in points if isinstance(p, list) and len(p) > 1]
        return out
    if isinstance(node, list):
        return node
    if isinstance(node, dict):
        return [node]
    raise EngineError("SOURCE_SCHEMA_MISMATCH", f"{path} is neither an array nor an object")


def text(v) -> str | None:
    if v is None:
        return None
    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def computed(e, row, params: dict):
    """Value of a computed column; any failure is None.

    e is one of path, current_row, null, from_filter, coalesce, to_timestamp, join, map_join, first_of, lookup, lookup_join, pick, literal, if_present,
    from_base64, replace, with its arguments: {"path": "a.b"}, {"coalesce": [e, ...]} and so on.
    """
    try:
        return _computed(e, row, params)
    except Exception:
        return None


def _items(e, row, params):
    v = computed(e, row, params)
    return v if isinstance(v, list) else []


def _computed(e, row, params):
    if isinstance(e, str):
        return row if e == "current_row" else None
    ((kind, a),) = e.items()
    sub = lambda x: computed(x, row, params)
    if kind == "path":
        node = row
        for k in a.removeprefix("$.").split("."):
            node = node[k]
        return node
    if kind == "current_row":
        return row
    if kind == "null":
        return None
    if kind == "from_filter":
        v = params.get(a)
        return None if v is None else str(v)
    if kind == "coalesce":
        return next((v for v in map(sub, a) if v is not None), None)
    if kind == "to_timestamp":
        v = sub(a["expr"])
        if isinstance(v, str):
            return v
        seconds = v / 1000 if a.get("unit") == "millis" else v
        return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)).isoformat().replace("+00:00", "Z")
    if kind == "join":
        v = sub(a["expr"])
        return a.get("separator", ",").join("" if x is None else text(x) for x in v) if isinstance(v, list) else None
    if kind == "map_join":
        v = sub(a["expr"])
        return a.get("separator", ",").join(text(y) for x in v if (y := walk(x, a["item_path"])) is not None) if isinstance(v, list) else None
    if kind == "first_of":
        return walk(_items(a["expr"], row, params)[0], a["item_path"])
    if kind == "lookup":
        return next(walk(x, a.get("value_field", "value")) for x in _items(a["expr"], row, params) if x.get(a.get("key_field", "key")) == a["key"])
    if kind == "lookup_join":
        return a.get("separator", ",").join(text(walk(x, a.get("value_field", "value"))) for x in _items(a["expr"], row, params) if x.get(a.get("key_field", "key")) == a["key"])
    if kind == "pick":
        v = sub(a["expr"])[str(params[a["param"]])]
        return walk(v, a["item_path"]) if a.get("item_path") else v
    if kind == "literal":
        return a
    if kind == "if_present":
        return a["then_value"] if sub(a["check"]) is not None else None
    if kind == "from_base64":
        return base64.b64decode(sub(a), validate=False).decode("utf-8")
    if kind == "replace":
        v = sub(a["expr"])
        return v.replace(a["from"], a["to"]) if isinstance(v, str) else None
    raise ValueError(kind)


_NAIVE = ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d")


def _moment(v) -> datetime | None:
    if not isinstance(v, str):
        return None
    try:
        return datetime.fromisoformat(v.replace("Z", "+00:00") if v.endswith("Z") else v)
    except ValueError:
        for f in _NAIVE:
            try:
                return datetime.strptime(v, f)
            except ValueError:
                continue
    return None


def cell(v, kind: str):
    """A JSON value as the declared type, None where it doesn't fit: integers cut fractions off and stay within bounds, doubles take trimmed text, times take
    RFC 3339, naive and date-only text."""
    k = kind.lower()
    if v is None:
        return None
    if k in ("int", "int32", "integer", "bigint", "int64", "long"):
        if isinstance(v, bool):
            return None
        if isinstance(v, str):
            try:
                n = int(v.strip())
            except ValueError:
                return None
        elif isinstance(v, float):
            n = max(-(2**63), min(2**63 - 1, int(v))) if v == v and abs(v) != float("inf") else None
        elif isinstance(v, int):
            n = v
        else:
            return None
        bound = 2**31 if k in ("int", "int32", "integer") else 2**63
        return n if n is not None and -bound <= n < bound else None
    if k in ("float", "float32", "double", "float64"):
        if isinstance(v, bool):
            return None
        try:
            return float(v.strip() if isinstance(v, str) else v)
        except (TypeError, ValueError, AttributeError):
            return None
    if k in ("bool", "boolean"):
        return v if isinstance(v, bool) else {"true": True, "false": False}.get(v.lower()) if isinstance(v, str) else None
    if k == "date":
        try:
            return date.fromisoformat(v[:10]) if isinstance(v, str) else None
        except ValueError:
            return None
    if k in ("timestamp", "timestamptz"):
        t = _moment(v)
        if t is None:
            return None
        utc = t.astimezone(timezone.utc) if t.tzinfo else t.replace(tzinfo=timezone.utc)
        return utc if k == "timestamptz" else utc.replace(tzinfo=None)
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False) if k == "json" else text(v)


def row_values(row, schema: list[dict], params: dict) -> tuple:
    """A row's cells: a computed ``expr``, ``source`` $.path, $ (the row) or param, or the field of the column's own name."""
    out = []
    for c in schema:
        src = c.get("source")
        if "expr" in c:
            v = computed(c["expr"], row, params)
        elif src == "param":
            v = params.get(c.get("param", c["name"]))
        elif src == "$":
            v = row
        elif src:
            v = walk(row, src)
        else:
            v = row.get(c["name"], params.get(c["name"])) if isinstance(row, dict) else None
        out.append(cell(v, c.get("type", "varchar")))
    return tuple(out)
