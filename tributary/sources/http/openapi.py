"""Table declarations from an OpenAPI 3.0 document."""

from __future__ import annotations

import fnmatch
import re

from tributary.errors import EngineError


def snake(name: str) -> str:
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower() or "table"


def column_type(schema: dict) -> str:
    t, f = schema.get("type"), schema.get("format")
    if t == "integer":
        return "int" if f == "int32" else "bigint"
    if t == "number":
        return "float" if f == "float" else "double"
    if t == "boolean":
        return "boolean"
    if t == "string":
        return {"date": "date", "date-time": "timestamptz"}.get(f, "varchar")
    return "json"


def _deref(node, doc: dict, depth: int = 0):
    while isinstance(node, dict) and "$ref" in node and depth < 16:
        at = doc
        for k in node["$ref"].removeprefix("#/").split("/"):
            at = at.get(k.replace("~1", "/").replace("~0", "~"), {})
        node, depth = at, depth + 1
    return node if isinstance(node, dict) else {}


def _rows(schema: dict, doc: dict) -> tuple[str, dict]:
    """Path of the rows and the schema of one: the array itself, or the only array of an object."""
    schema = _deref(schema, doc)
    if schema.get("type") == "array":
        return "$", _deref(schema.get("items", {}), doc)
    arrays = [(k, _deref(v, doc)) for k, v in schema.get("properties", {}).items() if _deref(v, doc).get("type") == "array"]
    if len(arrays) == 1:
        return f"$.{arrays[0][0]}", _deref(arrays[0][1].get("items", {}), doc)
    return "$", schema


# Parameter names by which pagination is recognised.
_PAGE, _OFFSET, _CURSOR, _SIZE = ("page", "page_number"), ("offset", "skip"), ("cursor", "page_token", "after"), ("limit", "per_page", "page_size")


def _pagination(names: list[str]) -> dict:
    size = next((n for n in names if n in _SIZE), None)
    for kind, known in (("page", _PAGE), ("offset", _OFFSET), ("cursor", _CURSOR)):
        found = next((n for n in names if n in known), None)
        if found:
            p = {"type": kind, "param": found}
            if kind == "offset" and size:
                p |= {"size_param": size, "size": 100}
            if kind == "cursor":
                p |= {"cursor_path": "$.next_cursor"}
            return p
    return {}


def synthesize(config: dict) -> list[dict]:
    """One table per GET operation of ``config`` {spec, include, exclude: {tags, paths, operations}, naming: operation_id, path or tag}."""
    doc = config["spec"]
    if not str(doc.get("openapi", "")).startswith("3.0"):
        raise EngineError("SOURCE_SCHEMA_MISMATCH", "only OpenAPI 3.0 documents are read")

    def listed(rule: dict, path: str, op: dict) -> bool:
        return bool(set(rule.get("tags", [])) & set(op.get("tags", []))) or any(fnmatch.fnmatch(path, g) for g in rule.get("paths", [])) or op.get("operationId") in rule.get("operations", [])

    out, used = [], set()
    for path, item in doc.get("paths", {}).items():
        op = item.get("get")
        if not op or (config.get("include") and not listed(config["include"], path, op)) or (config.get("exclude") and listed(config["exclude"], path, op)):
            continue
        naming = config.get("naming", "operation_id")
        base = snake({"path": path, "tag": (op.get("tags") or [path])[0]}.get(naming) or op.get("operationId") or path)
        name, k = base, 2
        while name in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name)
        given = [_deref(p, doc) for p in [*item.get("parameters", []), *op.get("parameters", [])]]
        pages = _pagination([p["name"] for p in given if p.get("in") == "query"])
        paging = {pages.get("param"), pages.get("size_param")}
        params = [
            {"name": p["name"], "in": p["in"], "required": bool(p.get("required")) or p["in"] == "path", "type": column_type(_deref(p.get("schema", {}), doc)), **({"default": p["schema"]["default"]} if "default" in _deref(p.get("schema", {}), doc) else {})}
            for p in given if p.get("in") in ("query", "path") and p["name"] not in paging
        ]
        ok = next((op["responses"][c] for c in ("200", "201", "default") if c in op.get("responses", {})), {})
        content = _deref(ok, doc).get("content", {})
        schema = next((v.get("schema", {}) for k2, v in content.items() if "json" in k2), {})
        rows_path, row = _rows(schema, doc)
        cols = [{"name": n, "type": column_type(_deref(s, doc))} for n, s in row.get("properties", {}).items()] or [{"name": "value", "type": "json", "source": "$"}]
        out.append({"name": name, "path": path, "params": params, "pagination": pages, "response": {"rows_path": rows_path, "schema": cols}, "description": op.get("summary", "")})
    return out


#: Blocks whose kind is one of their members, so that a patch replaces them whole.
_TAGGED = ("pagination", "body", "derive", "expr")


def merge(table: dict, patch: dict) -> dict:
    """Deep merge: objects merge, arrays and tagged blocks replace, null clears."""
    out = dict(table)
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        elif isinstance(v, dict) and isinstance(out.get(k), dict) and k not in _TAGGED:
            out[k] = merge(out[k], v)
        else:
            out[k] = v
    return out
