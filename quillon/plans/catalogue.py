"""How a query is registered: a function of (spark, sf_dir) under its name, with the oracle's SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from quillon.sources import views

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, head: bool = True):
    """Registers the function below it. With `head`, `sql` follows the views' WITH clause and may begin with further `, name as (...)`."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"with {views.SQL} {sql}" if head else sql
        return f

    return register
