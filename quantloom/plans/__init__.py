"""The registered queries of the market-analytics operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil


def _registries():
    for found in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if not found.name.startswith("_"):
            yield importlib.import_module(f"{__name__}.{found.name}").query


def queries() -> dict:
    out: dict = {}
    for registry in _registries():
        out |= registry.queries
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for registry in _registries():
        out |= registry.sql
    return out
