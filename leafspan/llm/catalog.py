"""All queries of this package."""

from importlib import import_module

from leafspan.llm.common import ORACLES, QUERIES

MODULES = ["packing", "decontamination", "fertility", "substrings", "suffixes", "sharding", "language", "lines", "minhash", "personal", "negatives", "manifest", "hmm"]


def _load() -> None:
    for module in MODULES:
        import_module(f"leafspan.llm.{module}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
