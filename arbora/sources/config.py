"""Settings of an index, from a mapping or a simple YAML file; keys that aren't known are reported, not taken."""

from __future__ import annotations

import sys
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    languages: tuple[str, ...] | None = None
    exclude_paths: tuple[str, ...] = ()
    respect_gitignore: bool = True
    prune_graph: bool = False
    centrality_ranking: bool = True
    embedding_provider: str = "lexical"
    embedding_dimensions: int = 1024
    min_cluster_size: int = 5
    use_louvain: bool = False
    bfs_depth: int = 3
    max_nodes_per_query: int = 200
    top_k: int = 10
    max_tokens: int = 4000
    min_semantic: float = 0.20
    enable_cfg: bool = True
    enable_dfg: bool = True


def from_mapping(values: dict, base: Config = Config()) -> Config:
    known = {f.name for f in fields(Config)}
    for key in sorted(set(values) - known):
        print(f"unknown setting {key!r}", file=sys.stderr)
    taken = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}
    return replace(base, **taken)


def parse(text: str) -> dict:
    """The flat part of YAML: ``key: value``, ``key: [a, b]`` and ``key:`` followed by ``- item`` lines."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- ") and key:
            out.setdefault(key, [])
            out[key] = [*(out[key] or []), _value(line.lstrip()[2:])]
        elif ":" in line:
            key, _, value = line.strip().partition(":")
            value = value.strip()
            out[key] = [_value(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else _value(value) if value else None
    return {k: v for k, v in out.items() if v is not None}


def _value(text: str):
    text = text.strip().strip("\"'")
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


# The names that a settings file may have.
NAMES = ("codegraph.yaml", "codegraph.yml", ".codegraph.yaml")


def find(folder: str, names: tuple[str, ...] = NAMES) -> str | None:
    """The nearest settings file in the folder or one above it."""
    at = Path(folder).resolve()
    return next((str(p / n) for p in (at, *at.parents) for n in names if (p / n).is_file()), None)


def load(path: str, base: Config = Config()) -> Config:
    return from_mapping(parse(Path(path).read_text(encoding="utf-8")), base)
