"""Workspace configuration: YAML files with includes, references to secrets, environment and files, variables; checked with coded errors."""

from __future__ import annotations

import os
import re
from pathlib import Path

from tributary.errors import EngineError
from tributary.semantic.model import Catalog

_REF = re.compile(r"\$\{(secret|env|file):([^}]+)\}")
VERSION = 1


def _load_yaml(path: Path) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise EngineError("CONFIG_YAML", "reading YAML needs the yaml package; pass a dictionary instead") from e
    try:
        out = yaml.safe_load(path.read_text(encoding="utf-8"))
    except OSError as e:
        raise EngineError("CONFIG_IO", str(e)) from e
    except yaml.YAMLError as e:
        raise EngineError("CONFIG_YAML", f"{path}: {e}") from e
    if not isinstance(out, dict):
        raise EngineError("CONFIG_SCHEMA", f"{path} is no mapping")
    return out


def interpolate(node, secrets: dict[str, str], base: Path):
    """A string that is exactly one reference is replaced; any other text stays as it is."""
    if isinstance(node, dict):
        return {k: interpolate(v, secrets, base) for k, v in node.items()}
    if isinstance(node, list):
        return [interpolate(v, secrets, base) for v in node]
    m = _REF.fullmatch(node) if isinstance(node, str) else None
    if not m:
        return node
    kind, name = m.groups()
    if kind == "secret":
        if name not in secrets:
            raise EngineError("CONFIG_UNRESOLVED_SECRET", name)
        return secrets[name]
    if kind == "env":
        if name not in os.environ:
            raise EngineError("CONFIG_UNRESOLVED_ENV", name)
        return os.environ[name]
    try:
        return (base / name).read_text(encoding="utf-8").rstrip("\n")
    except OSError as e:
        raise EngineError("CONFIG_READ_FILE", str(e)) from e


def load(path: str | Path, secrets: dict[str, str] | None = None) -> dict:
    """The configuration of a file and of all that it includes; lists of sources, functions, models and metrics are joined, names must stay unique."""
    return check(_merge(Path(path), secrets or {}, ()))


def _merge(path: Path, secrets: dict[str, str], chain: tuple[Path, ...]) -> dict:
    path = path.resolve()
    if path in chain:
        raise EngineError("CONFIG_INCLUDE_CYCLE", " -> ".join(map(str, [*chain, path])))
    own = interpolate(_load_yaml(path), secrets, path.parent)
    for s in own.get("sources", []):
        c = s.setdefault("config", {})
        if isinstance(c.get("path"), str) and not re.match(r"^\w+://|^/", c["path"]):
            c["path"] = str(path.parent / c["path"])
    for pattern in own.pop("include", []):
        files = sorted(path.parent.glob(pattern))
        if not files and not any(ch in pattern for ch in "*?["):
            raise EngineError("CONFIG_IO", f"{pattern}: no such file")
        for f in files:
            part = _merge(f, secrets, (*chain, path))
            for k in ("sources", "functions", "variables"):
                own[k] = [*own.get(k, []), *part.get(k, [])]
            sem = own.setdefault("semantic", {})
            for k in ("models", "metrics"):
                sem[k] = [*sem.get(k, []), *part.get("semantic", {}).get(k, [])]
    return own


RESERVED = {"materialized", "system", "semantic", "information_schema", "default"}


def check(c: dict) -> dict:
    """The configuration if it is sound; sources and functions have unique names that aren't reserved, the semantic section refers to what exists."""
    if c.get("version", VERSION) != VERSION:
        raise EngineError("CONFIG_UNSUPPORTED_VERSION", str(c.get("version")))
    seen: set[str] = set()
    for s in c.get("sources", []):
        if "name" not in s or "kind" not in s:
            raise EngineError("CONFIG_SOURCE", f"a source needs name and kind: {s}")
        if s["name"] in RESERVED:
            raise EngineError("CONFIG_SOURCE", f"{s['name']!r} is reserved")
        if s["name"] in seen:
            raise EngineError("CONFIG_SOURCE", f"two sources are called {s['name']!r}")
        seen.add(s["name"])
    Catalog.from_dict(c.get("semantic") or {})
    for v in c.get("variables", []):
        if "name" not in v:
            raise EngineError("CONFIG_VARIABLE", f"a variable needs a name: {v}")
    return c
