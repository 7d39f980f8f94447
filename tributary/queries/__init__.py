"""Registered queries of the core: QUERIES maps a name to (spark, sf_dir) -> DataFrame, ORACLE to the same result as SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["timestamps", "skew", "orphans", "orders", "relational", "jsonq", "semantic", "sources", "scalars", "http", "verbs"]


def collect() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for m in _MODULES:
        mod = import_module(f"tributary.queries.{m}")
        queries |= mod.QUERIES
        oracle |= getattr(mod, "ORACLE", {})
    return queries, oracle
