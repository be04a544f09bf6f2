"""Settings of the engine, from the environment where it has them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache


@dataclass(frozen=True)
class Settings:
    embedding_dim: int = 64
    index_path: str = "./data/index"
    vector_path: str = "./data/vectors"
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_size: int = 100
    top_k: int = 5
    use_web_search: bool = True
    use_cache: bool = True
    include_source: bool = True
    vector_score: str = "cosine"
    probe_cells: int = 0
    cache_entries: int = 1000
    cache_seconds: int = 3600
    debug: bool = True


@lru_cache
def settings() -> Settings:
    """Defaults, overridden by variables like PLUMBAGO_CHUNK_SIZE."""
    given = {}
    for f in fields(Settings):
        if (v := os.environ.get(f"PLUMBAGO_{f.name.upper()}")) is not None:
            kind = type(f.default)
            given[f.name] = v.lower() in ("1", "true") if kind is bool else kind(v)
    return Settings(**given)
