"""Registered queries over the given tables, each with an equivalent SQL text.

Every module holds ``QUERIES`` (name -> callable) and ``SQL`` (name -> text).
"""

from __future__ import annotations

import importlib

MODULES = ("bars", "patterns", "statements", "scan", "profiles", "feeds", "texts", "sources", "stores", "rules")


def load() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"barloom.registry.{name}")
        clash = set(queries) & set(module.QUERIES)
        if clash:
            raise ValueError(f"duplicate query names: {sorted(clash)}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
