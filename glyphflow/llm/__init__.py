"""Operators for training data of language models, with their queries and SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["runs", "pairs", "spans", "lookalikes", "mixing", "leaks", "abuse"]


def registry() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
