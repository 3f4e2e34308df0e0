"""Run configuration from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from leafspan.plans.strategies import TreeGraphSettings


@dataclass(frozen=True)
class TopK:
    """Settings of a strategy that has only a result size and a depth."""

    topk: int = 5
    max_depth: int = -1


STRATEGIES: dict[str, type] = {
    "tree_graph": TreeGraphSettings, "graph": TopK, "vector": TopK, "lexical": TopK, "multimodal": TopK, "traverse": TopK,
}


@dataclass(frozen=True)
class RunConfig:
    """Folders, the chosen strategy with its settings, and whatever else the file holds."""

    strategy: str
    settings: Any
    save_path: str = ""
    extra: dict = field(default_factory=dict)


def load_config(path: str) -> RunConfig:
    """Read a YAML file; the ``rag`` section selects the settings class by its ``strategy`` key."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        raw = yaml.safe_load(handle) or {}
    section = dict(raw.pop("rag", {}))
    name = section.pop("strategy", "tree_graph")
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name}; choose one of {', '.join(STRATEGIES)}")
    known = {f.name for f in fields(STRATEGIES[name])}
    unknown = set(section) - known
    if unknown:
        raise ValueError(f"unknown settings for {name}: {', '.join(sorted(unknown))}")
    return RunConfig(name, STRATEGIES[name](**section), raw.pop("save_path", ""), raw)
