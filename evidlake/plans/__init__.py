"""Queries: operators bound to the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "hybrid_rrf"
_MODULES = ("feeds", "searches", "evidences", "audits", "logs", "texts", "windows", "writes")


def _all(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f"evidlake.plans.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
