"""Settings that change results, with the checks made when they are loaded."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

MODES = ("precision", "discovery", "exact")
PIPELINES = ("bm25", "dense", "hybrid", "hybrid_rerank")
KINDS = ("paper", "section", "chunk", "curated")


@dataclass(frozen=True)
class ChunkSettings:
    target_tokens: int = 850
    min_tokens: int = 250
    max_tokens: int = 1600

    def __post_init__(self):
        if not 0 < self.min_tokens <= self.target_tokens <= self.max_tokens:
            raise ValueError("need 0 < min_tokens <= target_tokens <= max_tokens")


@dataclass(frozen=True)
class RetrievalSettings:
    bm25_candidates: int = 60
    dense_candidates: int = 60
    rerank_candidates: int = 40
    rrf_k: int = 60
    default_top_k: int = 10
    precision_max_results_per_paper: int = 3
    discovery_max_results_per_paper: int = 2
    exact_max_results_per_paper: int = 10
    snippet_words: int = 300

    def __post_init__(self):
        bad = [f.name for f in fields(self) if getattr(self, f.name) <= 0]
        if bad:
            raise ValueError(f"must be positive: {', '.join(bad)}")

    def per_paper(self, mode: str) -> int:
        return getattr(self, f"{mode}_max_results_per_paper")


@dataclass(frozen=True)
class EmbeddingSettings:
    backend: str = "hash"
    model: str = ""
    dimensions: int = 768
    max_length: int = 2048
    precision: str = "auto"
    query_instruction: str = ""
    revision: str = ""
    allow_hash_fallback: bool = False

    def __post_init__(self):
        if not 0 < self.dimensions <= 8192:
            raise ValueError("embedding dimensions must lie in 1..8192")
        if not 0 < self.max_length <= 2048:
            raise ValueError("embedding max_length must lie in 1..2048")


@dataclass(frozen=True)
class ServiceSettings:
    max_top_k: int = 20
    max_section_tokens: int = 12000

    def __post_init__(self):
        if self.max_top_k <= 0 or self.max_section_tokens <= 0:
            raise ValueError("service limits must be positive")


@dataclass(frozen=True)
class LayoutSettings:
    """Physical layout of the written index; raise all three with the data."""

    term_buckets: int = 8
    entity_buckets: int = 8
    paper_blocks: int = 8


@dataclass(frozen=True)
class Settings:
    chunks: ChunkSettings = field(default_factory=ChunkSettings)
    retrieval: RetrievalSettings = field(default_factory=RetrievalSettings)
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    service: ServiceSettings = field(default_factory=ServiceSettings)
    layout: LayoutSettings = field(default_factory=LayoutSettings)
    exclude_dirs: tuple[str, ...] = ()

    def __post_init__(self):
        if self.chunks.max_tokens > self.embedding.max_length:
            raise ValueError("chunks.max_tokens may not exceed embedding.max_length")

    def as_dict(self) -> dict:
        return asdict(self)


def load_settings(path: str | Path) -> Settings:
    return settings_from(tomllib.loads(Path(path).read_text(encoding="utf-8")))


def settings_from(raw: dict) -> Settings:
    def build(cls, name):
        section = raw.get(name, {})
        if not isinstance(section, dict):
            raise ValueError(f"[{name}] must be a table")
        known = {f.name for f in fields(cls)}
        unknown = set(section) - known
        if unknown:
            raise ValueError(f"[{name}] has unknown keys: {', '.join(sorted(unknown))}")
        return cls(**section)

    return Settings(
        chunks=build(ChunkSettings, "chunks"),
        retrieval=build(RetrievalSettings, "retrieval"),
        embedding=build(EmbeddingSettings, "embedding"),
        service=build(ServiceSettings, "service"),
        layout=build(LayoutSettings, "layout"),
        exclude_dirs=tuple(raw.get("exclude_dirs", ())),
    )
