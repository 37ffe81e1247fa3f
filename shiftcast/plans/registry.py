"""All catalogs in one place."""

from __future__ import annotations

from importlib import import_module

from .base import Catalog, Query

MODULES = ["staffing", "features", "rollups", "accuracy", "scenarios", "analysis", "models", "flows"]


def _catalogs() -> list[Catalog]:
    return [import_module(f".{m}", __package__).catalog for m in MODULES]


def _merge(maps: list[dict]) -> dict:
    out: dict = {}
    for m in maps:
        twice = out.keys() & m.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        out.update(m)
    return out


def all_queries() -> dict[str, Query]:
    return _merge([c.queries for c in _catalogs()])


def all_sql() -> dict[str, str]:
    return _merge([c.sql for c in _catalogs()])
