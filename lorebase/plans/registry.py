"""How a module of plans lists its queries."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """Queries, their SQL, and a decorator that enters a function under its name with its SQL (None: SQL can't state it)."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None) -> Callable:
        def enter(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return enter

    return queries, oracles, query
