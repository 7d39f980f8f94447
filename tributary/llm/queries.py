"""Registered queries of this subpackage."""

from importlib import import_module

QUERIES: dict = {}
ORACLE: dict = {}
for _m in ["orders_queries", "text_queries"]:
    _mod = import_module(f"tributary.llm.{_m}")
    QUERIES |= _mod.QUERIES
    ORACLE |= _mod.ORACLE
