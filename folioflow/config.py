"""Settings: frozen values, checked when made; read from the environment and an optional file of KEY=VALUE lines."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class EmbeddingSettings:
    provider: str = "mock"
    model_name: str = "mock-embedder"
    model_version: str = "v1"
    dimension: int = 64
    api_key: str | None = None
    max_retries: int = 3
    cost_per_1k_tokens: float = 0.00013


@dataclass(frozen=True)
class CacheSettings:
    enabled: bool = True
    max_entries: int = 1000
    ttl_seconds: int = 3600

    def limits(self) -> tuple[int, int]:
        """A disabled cache holds one entry for one second."""
        return (self.max_entries, self.ttl_seconds) if self.enabled else (1, 1)


@dataclass(frozen=True)
class RetrievalSettings:
    default_top_k: int = 5
    max_top_k: int = 50
    candidates: int = 50
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    default_mode: str = "hybrid"
    rerank: bool = True
    min_similarity: float = 0.0


@dataclass(frozen=True)
class Settings:
    embedding: EmbeddingSettings = EmbeddingSettings()
    cache: CacheSettings = CacheSettings()
    retrieval: RetrievalSettings = RetrievalSettings()
    environment: str = "development"
    query_log: str | None = None

    def __post_init__(self) -> None:
        r = self.retrieval
        if self.embedding.dimension <= 0:
            raise ValueError("the dimension must be positive")
        if r.default_top_k > r.max_top_k:
            raise ValueError("default_top_k is above max_top_k")
        if abs(r.vector_weight + r.keyword_weight - 1) > 0.001:
            raise ValueError("the hybrid weights must add up to 1")
        if self.environment == "production" and self.embedding.provider != "mock" and not self.embedding.api_key:
            raise ValueError("production needs a key for the embedding model")


def read_env_file(path: Path) -> dict[str, str]:
    """KEY=VALUE lines; blank lines and comments are skipped, quotes around values dropped. A missing file is empty."""
    if not path.exists():
        return {}
    pairs = (line.partition("=") for line in map(str.strip, path.read_text().splitlines()) if line and line[0] != "#" and "=" in line)
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs if k.strip()}


def load_settings(env: Mapping[str, str] | None = None, env_file: Path | None = None) -> Settings:
    """What the environment sets wins over the file, and both over the defaults."""
    values = (read_env_file(env_file) if env_file else {}) | dict(os.environ if env is None else env)

    def get(name: str, default, kind=str):
        raw = values.get(name)
        if raw is None:
            return default
        if kind is bool:
            return raw.strip().lower() in ("true", "1", "yes", "on")
        try:
            return kind(raw)
        except ValueError as error:
            raise ValueError(f"{name}={raw} is no {kind.__name__}") from error

    e, c, r = EmbeddingSettings(), CacheSettings(), RetrievalSettings()
    return Settings(
        EmbeddingSettings(
            get("EMBEDDING_PROVIDER", e.provider), get("EMBEDDING_MODEL", e.model_name), get("EMBEDDING_MODEL_VERSION", e.model_version),
            get("EMBEDDING_DIMENSION", e.dimension, int), get("EMBEDDING_API_KEY", None), get("EMBEDDING_MAX_RETRIES", e.max_retries, int),
            get("EMBEDDING_COST_PER_1K", e.cost_per_1k_tokens, float),
        ),
        CacheSettings(get("CACHE_ENABLED", c.enabled, bool), get("CACHE_MAX_ENTRIES", c.max_entries, int), get("CACHE_TTL_SECONDS", c.ttl_seconds, int)),
        RetrievalSettings(
            get("RETRIEVAL_DEFAULT_K", r.default_top_k, int), get("RETRIEVAL_MAX_K", r.max_top_k, int), get("RETRIEVAL_RERANK_CANDIDATES", r.candidates, int),
            get("HYBRID_VECTOR_WEIGHT", r.vector_weight, float), get("HYBRID_KEYWORD_WEIGHT", r.keyword_weight, float),
            get("RETRIEVAL_DEFAULT_MODE", r.default_mode), get("ENABLE_RERANK", r.rerank, bool), get("MIN_SIMILARITY_THRESHOLD", r.min_similarity, float),
        ),
        get("ENVIRONMENT", "development"),
        get("QUERY_LOG_FILE", None),
    )
