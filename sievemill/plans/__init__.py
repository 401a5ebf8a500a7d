"""Queries over the test tables."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules

from sievemill.plans import registry


def _load() -> None:
    for m in iter_modules(__path__):
        if m.name.endswith("_queries"):
            import_module(f"{__name__}.{m.name}")


def all_queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def all_sql() -> dict:
    _load()
    return {k: v if isinstance(v, str) else v() for k, v in registry.SQL.items()}
