"""Named queries over the derived tables, each with an equal SQL statement where SQL
can express it."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("pairs", "tagging", "content", "graphs", "streams")


def load() -> tuple[dict, dict]:
    """All registered queries and SQL statements."""
    for name in _MODULES:
        import_module(f"tagweave.catalog.{name}")
    from tagweave.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
