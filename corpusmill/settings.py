"""Settings with defaults, read from environment variables ``CORPUSMILL_<NAME>``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    collection: str = "corpus_v1"
    dense_dim: int = 1024
    sparse_dim: int = 30_000
    window_words: int = 220
    overlap_words: int = 40
    least_tail_words: int = 80
    search_limit: int = 10
    rrf_k: int = 60
    topical_limit: int = 10
    specific_limit: int = 5
    negative_limit: int = 5
    least_candidates: int = 1
    least_dense_hits: int = 1
    least_sparse_hits: int = 1
    least_citationable: int = 1


def load_settings(env: dict[str, str] | None = None) -> Settings:
    """Settings from the environment; a value that is no whole number gives the default."""
    env = os.environ if env is None else env
    found: dict[str, object] = {}
    for f in fields(Settings):
        raw = env.get(f"CORPUSMILL_{f.name.upper()}")
        if raw is None:
            continue
        if isinstance(f.default, str):
            found[f.name] = raw
        elif raw.strip().lstrip("-").isdigit():
            found[f.name] = int(raw)
    return Settings(**found)
