"""Settings of retrieval and compiling, and what must hold between them; the ladder of ablations is a set of changes to them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class RetrievalConfig:
    chunk_tokens: int = 512
    overlap_tokens: int = 64
    hits: int = 40
    hits_with_budget: int = 500
    reranked: int = 20
    reranked_most: int = 250
    hit_multiple: float = 3.0
    rerank_multiple: float = 2.0
    rrf: int = 60
    token_counter: str = "words-v1"
    embedder: str = "hash-256"
    reranker: str = "lexical-overlap-v1"

    def __post_init__(self) -> None:
        _need(0 <= self.overlap_tokens < self.chunk_tokens, "an overlap has to be smaller than its window")
        _need(0 < self.reranked <= self.reranked_most <= self.hits_with_budget, "pools have to nest")
        _need(self.rrf > 0 and self.hit_multiple > 0 and self.rerank_multiple > 0, "constants of fusion and trims have to be positive")


@dataclass(frozen=True)
class MergeConfig:
    small: int = 64
    target: int = 128
    most: int = 256
    pages: int = 1

    def __post_init__(self) -> None:
        _need(0 < self.small <= self.target <= self.most and self.pages >= 0, "small <= target <= most has to hold")


@dataclass(frozen=True)
class FacetConfig:
    facets: int = 3
    least_terms: int = 3
    query_weight: float = 2.0
    facet_weight: float = 1.0
    token_cap: int | None = None

    def __post_init__(self) -> None:
        _need(self.facets >= 0 and self.least_terms >= 1 and self.query_weight > 0 and self.facet_weight > 0, "facets need terms and weights")


@dataclass(frozen=True)
class CompilerConfig:
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    merge: MergeConfig | None = None
    facets: FacetConfig | None = field(default_factory=FacetConfig)
    headings: bool = True
    heading_depth: int | None = None
    siblings: int = 1
    list_neighbors: int = 1
    joins: bool = True
    page_radius: int = 3
    pool: int = 500
    strategy: str = "ranked"

    def __post_init__(self) -> None:
        _need(self.strategy in ("ranked", "coverage", "adaptive"), "a packet is packed by rank, by coverage, or by coverage until breadth is exhausted")
        _need(min(self.siblings, self.list_neighbors, self.page_radius) >= 0 and self.pool > 0, "distances can't be negative, and a pool holds something")


@dataclass(frozen=True)
class BenchmarkConfig:
    budgets: tuple[int, ...] = (2048, 4096, 8192, 16384)
    compiler: CompilerConfig = field(default_factory=CompilerConfig)
    baseline: RetrievalConfig = field(default_factory=RetrievalConfig)
    draws: int = 10_000
    seed: int = 0

    def __post_init__(self) -> None:
        _need(bool(self.budgets) and list(self.budgets) == sorted(set(self.budgets)) and self.budgets[0] > 0, "budgets have to rise and be positive")
        _need(self.compiler.retrieval == self.baseline, "all systems have to share one retrieval")
        _need(self.draws > 0, "an interval needs draws")


def ablations(base: CompilerConfig | None = None) -> dict[str, CompilerConfig]:
    """Each rung takes one more part away from what is shipped."""
    base = base or CompilerConfig()
    rungs = {"SHIPPED": base, "D1": replace(base, joins=False)}
    rungs["D2"] = replace(rungs["D1"], page_radius=0)
    rungs["D3"] = replace(rungs["D2"], siblings=0, list_neighbors=0)
    rungs["D4"] = replace(rungs["D3"], facets=None, headings=False)
    return rungs
