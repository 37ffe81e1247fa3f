"""Imports the modules that register queries."""

from __future__ import annotations

from importlib import import_module

from .common import QUERIES, SQL

MODULES = [
    "exact_dedup",
    "quality",
    "bpe",
    "token_counts",
    "packing",
    "mixing",
    "sharding",
    "minhash",
    "toxicity",
    "passages",
    "chat",
    "alignment",
    "spelling",
]

for _name in MODULES:
    import_module(f".{_name}", __package__)


def llm_queries() -> dict:
    return dict(QUERIES)


def llm_sql() -> dict[str, str]:
    return dict(SQL)
