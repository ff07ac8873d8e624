"""Settings with typed defaults, from the environment where it has them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    chunk_chars: int = 1200
    chunk_overlap: int = 150
    top_k_vector: int = 20
    top_k_text: int = 20
    rerank_pool: int = 30
    top_k: int = 8
    window_chars: int = 90_000
    window_overlap: int = 2_000
    embedding_size: int = 1024
    head_chars: int = 8_000

    @classmethod
    def from_env(cls, prefix: str = "LEXMILL_") -> Config:
        """A value that isn't a number is an error, never a silent default."""
        given = {f.name: int(os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return cls(**given)
