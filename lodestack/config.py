"""Configuration: a tree of dataclasses from a dict or a YAML file; unknown keys are errors."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass
class Chunking:
    strategy: str = "greedy"  # greedy, late, semantic, agentic, proposition
    chunk_size: int = 1000
    chunk_overlap: int = 200
    separators: tuple[str, ...] = ("\n\n", "\n", ".", "!", "?", ",", " ")
    breakpoint_percentile: float = 25.0
    min_chunk_size: int = 100
    late_chunk_size: int = 512
    propositions_per_chunk: int = 5


@dataclass
class Retrieval:
    strategy: str = "dense"  # dense, keyword, hybrid, multi-query, self-rag, graph, advanced-graph, tree
    top_k: int = 5
    bm25_weight: float = 0.5
    rrf_constant: int = 60
    num_queries: int = 3
    corrective: bool = False
    compression: bool = False
    reranker: str | None = None
    max_graph_hops: int = 2
    search_mode: str = "local"  # local, global, drift


@dataclass
class Models:
    embedding: str = "hashing"
    embedding_dimension: int = 64
    llm: str = "extractive"


@dataclass
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    models: Models = field(default_factory=Models)

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> "Config":
        return _fill(cls, values, "")

    @classmethod
    def from_yaml(cls, path: str) -> "Config":
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()) or {})


def _fill(kind: type, values: dict[str, Any], at: str) -> Any:
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"unknown configuration keys: {', '.join(at + k for k in unknown)}")
    out = kind()
    for k, v in values.items():
        current = getattr(out, k)
        if is_dataclass(current):
            v = _fill(type(current), v, f"{at}{k}.")
        elif isinstance(current, tuple):
            v = tuple(v)
        setattr(out, k, v)
    return out
