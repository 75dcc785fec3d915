"""Registered queries: one per operator, with the SQL they must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "market", "stats", "cleaning", "features", "text", "persona", "trends", "gates", "deltas", "product", "matching", "sources",
)


def load() -> None:
    for module in MODULES:
        import_module(f"postmill.queries.{module}")
