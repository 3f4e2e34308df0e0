"""All registered queries."""

from importlib import import_module

from leafspan.catalog.base import ORACLES, QUERIES

MODULES = ["lexical", "vectors", "ranking", "blocks", "tree", "entities", "graph", "evaluate", "text", "answers", "sources", "merging"]


def _load() -> None:
    for module in MODULES:
        import_module(f"leafspan.catalog.{module}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
