"""Query registry: every core query with its SQL, gathered from the modules that define them."""

from __future__ import annotations

from importlib import import_module

MODULES = [f"operators.{m}" for m in ("tree", "orphans", "ngrams", "positional", "cooc", "corpus", "context", "words", "phonetics", "matching", "segment", "graph", "describe", "evidence", "neighbors", "exchange", "hypotheses")]


def registry() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"glyphflow.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
