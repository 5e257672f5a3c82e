"""Parameters of retrieval, chunking and the agent."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, default: str) -> str:
    return os.environ.get(name, default)


def _flag(name: str, default: bool) -> bool:
    value = os.environ.get(name)
    return default if value is None else value.strip().lower() in {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    """Defaults are semantics; environment variables override them when an instance is made."""

    top_k_vector: int = field(default_factory=lambda: int(_env("TOP_K_VECTOR", "20")))
    top_k_bm25: int = field(default_factory=lambda: int(_env("TOP_K_BM25", "20")))
    top_k_final: int = field(default_factory=lambda: int(_env("TOP_K_FINAL", "6")))
    rrf_k: int = field(default_factory=lambda: int(_env("RRF_K", "60")))
    max_tokens: int = 400
    overlap: int = 80
    max_iterations: int = field(default_factory=lambda: int(_env("MAX_ITERATIONS", "3")))
    confidence_threshold: float = field(default_factory=lambda: float(_env("REFLECT_CONFIDENCE_THRESHOLD", "0.8")))
    max_sub_queries: int = field(default_factory=lambda: int(_env("MAX_SUB_QUERIES", "4")))
    embed_provider: str = field(default_factory=lambda: _env("EMBED_PROVIDER", "hashed"))
    embed_model: str = field(default_factory=lambda: _env("EMBED_MODEL", "hashed-tokens"))
    embed_dim: int = field(default_factory=lambda: int(_env("EMBED_DIM", "64")))
    embed_batch: int = 32
    rerank_provider: str = field(default_factory=lambda: _env("RERANK_PROVIDER", "none"))
    llm_model: str = field(default_factory=lambda: _env("LLM_MODEL", "scripted"))
    llm_api_key: str = field(default_factory=lambda: _env("LLM_API_KEY", ""))
    index_dir: str = field(default_factory=lambda: _env("INDEX_DIR", "data/index"))
    docs_dir: str = field(default_factory=lambda: _env("DOCS_DIR", "data/docs"))
    cache_dir: str = field(default_factory=lambda: _env("CACHE_DIR", "data/cache"))
    enable_cache: bool = field(default_factory=lambda: _flag("ENABLE_CACHE", True))

    def candidates(self, top_k: int | None = None) -> int:
        """How many fused rows go to the reranker."""
        return max(4 * (top_k or self.top_k_final), 12)

    @property
    def has_llm_credentials(self) -> bool:
        return bool(self.llm_api_key)
