"""Settings of an engine, with their usual values (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    merge_strategy: str = "set-union"  # or rrf
    relevance_floor: float = 0.0
    max_chunks_per_page: int = 1
    graph_depth: int = 0
    graph_decay: float = 0.5
    graph_max_added: int = 50
    mmr_lambda: float = 1.0
    cross_reference_weight: float = 0.05
    cross_reference_cap: float = 0.15
    window_turns: int = 5
    idle_close_ms: int = 60_000
    debounce_ms: int = 5_000
    max_retries: int = 3
    dedup_cosine_min: float = 0.92
    supersede_cosine_min: float = 0.4
    novelty_jaccard: float = 0.85
    novelty_cosine: float = 0.95
    embedding_width: int = 384

    @classmethod
    def from_rows(cls, rows: dict[str, str]) -> EngineConfig:
        """Text values by name; unknown names and values that don't parse leave the usual value."""
        found = {}
        for f in fields(cls):
            if f.name in rows:
                kind = type(f.default)
                try:
                    found[f.name] = kind(rows[f.name])
                except ValueError:
                    pass
        return cls(**found)


#: Embedding models by name and the width of their vectors (fixed values).
MODELS = {"small": 384, "base": 768, "large": 1024, "m3": 1024}


def model_width(name: str, custom: int | None = None) -> int:
    if name in MODELS:
        return MODELS[name]
    if custom:
        return custom
    raise ValueError(f"unknown model {name}")
