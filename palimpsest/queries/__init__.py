"""Catalogue of registered queries and their oracles."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("search", "ingest", "topics", "upkeep")
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in _MODULES:
    _m = import_module(f"palimpsest.queries.{_name}")
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
