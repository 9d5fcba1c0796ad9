"""Queries of the operators for training data, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("near_queries", "pieces_queries", "splits_queries", "pii_queries", "packing_queries", "leaks_queries", "subjects_queries")

QUERIES: dict = {}
SQL: dict = {}
for _m in _MODULES:
    _module = import_module(f"evidlake.llm.{_m}")
    QUERIES |= _module.QUERIES
    SQL |= getattr(_module, "SQL", {})
