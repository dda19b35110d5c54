"""Settings, as one tree of dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Chunking:
    size: int = 100_000
    overlap: int = 1_000


@dataclass(frozen=True)
class Search:
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    semantic_weight: float = 0.7
    keyword_weight: float = 0.3
    rerank_input: int = 20
    rerank_output: int = 10
    #: Questions that are broadcast at once; more are held against the corpus in blocks.
    query_block: int = 1_000


@dataclass(frozen=True)
class Selection:
    min_chunks: int = 3
    max_chunks: int = 10
    duplicate_above: float = 0.85
    diversity_at_most: float = 0.8


@dataclass(frozen=True)
class Sessions:
    max_tokens: int = 128_000
    compact_above: float = 0.8
    keep_messages: int = 6
    keep_tokens: int = 6_000
    ttl_hours: int = 72


@dataclass(frozen=True)
class Calls:
    cache_ttl_s: int = 3_600
    cache_entries: int = 1_000
    max_depth: int = 3
    max_calls: int = 100
    failures_to_open: int = 5
    open_s: int = 60
    probes: int = 3
    successes_to_close: int = 2


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    search: Search = field(default_factory=Search)
    selection: Selection = field(default_factory=Selection)
    sessions: Sessions = field(default_factory=Sessions)
    calls: Calls = field(default_factory=Calls)
    model: str = "gpt-5-mini"


SETTINGS = Settings()
