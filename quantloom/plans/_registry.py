"""How a plan module declares its queries."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries and their SQL by name, filled by the decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(name)
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
