"""Parameters of the jobs, with the defaults that give the documented results."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Dense and sparse weights by preset.
PRESETS = {
    "balanced": (0.50, 0.50),
    "semantic_first": (0.60, 0.40),
    "keyword_first": (0.40, 0.60),
    "dense_only": (1.00, 0.00),
    "sparse_only": (0.00, 1.00),
}


@dataclass(frozen=True)
class Params:
    top_k: int = 8
    candidates: int = 10
    rrf_k: int = 60
    sparse_threshold: float = 0.05
    section_boost: float = 1.2
    mmr_lambda: float = 0.7
    max_per_source: int = 2
    dedup_similarity: float = 0.85
    chunk_chars: int = 500
    chunk_overlap: int = 100
    chunk_least: int = 200
    dims: int = 64
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    weights: tuple[float, float] = field(default=PRESETS["balanced"])

    def per_channel(self, top_k: int | None = None) -> int:
        """Candidates that each channel gives for top_k results."""
        return max(self.candidates, 4 * (self.top_k if top_k is None else top_k))


def preset(name: str) -> tuple[float, float]:
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]
