"""Parameters of the retrieval operators, with their effective defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class BlockParams:
    max_words: int = 150
    min_words: int = 20


@dataclass(frozen=True)
class RetrievalParams:
    first_stage_top_k: int = 50
    final_top_k: int = 10
    bm25_top_k: int = 20
    fusion_alpha: float = 1.0
    rrf_k: int = 60
    rewrites: int = 3
    rewrite_dense_k: int = 20
    rewrite_bm25_k: int = 10
    rewrite_gate: float = 0.7
    nav_pages: int = 5
    nav_blocks: int = 10
    hybrid_cap: int = 15
    mmr_lambda: float = 0.0
    mmr_url_weight: float = 1.0
    related_links: int = 15


@dataclass(frozen=True)
class RouterParams:
    hybrid_threshold: float = 0.75
    default_confidence: float = 0.7
    disable_hybrid: bool = True
    auto_alt_floor: float = 0.6


@dataclass(frozen=True)
class ResolutionParams:
    embedding_weight: float = 0.7
    fuzzy_weight: float = 0.3
    auto_merge: float = 0.92
    review: float = 0.90
    surname_bonus: float = 0.1
    candidates: int = 5


@dataclass(frozen=True)
class ScoringParams:
    alpha: float = 0.5
    beta: float = 0.35
    gamma: float = 0.15
    coverage_cap: int = 5
    max_tokens: int = 300
    default_tokens: int = 100
    same_page_cap: int = 5
    same_page_discount: float = 0.5
    token_budget: int = 4000
    entity_limit: int = 30
    subgraph_entities: int = 25
    subgraph_edges: int = 40


@dataclass(frozen=True)
class DedupParams:
    max_group_size: int = 20
    min_group_size: int = 2
    empty_hash: str = "e3b0c44298"  # first ten characters of the digest of nothing


@dataclass(frozen=True)
class UrlRules:
    """Rules of the drop-reason cascade. Hosts are the caller's own."""

    # fixed values: prefixes, extensions, paths and dated patterns of the cascade (one exact path that names a site is left out)
    min_year: int = 2024
    language_prefixes: tuple[str, ...] = ("tc", "sc")
    extensions: tuple[str, ...] = (
        ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".jpg", ".jpeg", ".png", ".gif", ".mp4",
    )
    host_suffixes: tuple[str, ...] = ()
    host_path_prefixes: tuple[tuple[str, str], ...] = ()
    path_prefixes: tuple[str, ...] = ("/login",)
    exact_paths: tuple[str, ...] = ("/notfound.html", "/sitemap", "/accessibility", "/privacy-policy-statement", "/terms-of-use", "/photo-gallery", "/atoz", "/social-media")
    # group 1 is the year
    dated_patterns: tuple[str, ...] = (
        r"^/media/media-releases/(\d{4})/",
        r"^/en/media/media-releases/(\d{4})/",
        r"^/events/(\d{4})/",
        r"^/en/events/(\d{4})/",
        r"^/recent-focus/(\d{4})\d{4}",
        r"^/[^/]+/news-and-events/.*?(\d{4})",
        r"^/[^/]+/latest-news/.*?(\d{4})",
        r"^/publications/[^/]+/issue/(\d{4})",
        r"^/study/pg/research-postgraduate/(\d{4})/",
        r"^/[^/]+/study/.*?(\d{4})-entry",
        r"^/study/.*?(\d{4})-entry",
    )


# fixed values: page types in rule order; any substring of the url decides
PAGE_TYPES = (
    ("staff-list", ("/people/academic-staff", "/people/academic-teaching-staff")),
    ("personal-homepage", ("/people/academic-staff/",)),
    ("programme", ("/study/", "/programme/")),
    ("course", ("/course/",)),
    ("admissions", ("/admission",)),
    ("fee", ("/fee", "/tuition")),
    ("scholarship", ("/scholarship",)),
)
# fixed values: urls worth crawling first
PRIORITY_PATTERNS = (
    "/study/.*/entrance-requirements",
    "/study/.*/curriculum",
    "/study/.*/subjects",
    "/study/.*/faq",
    "/study/.*/programme-features",
)
# fixed values: entity types, in the order in which contained names are tried
ENTITY_TYPES = ("PERSON", "PROGRAMME", "COURSE", "DEPARTMENT", "RESEARCH_AREA", "FACILITY", "POLICY", "SCHOLARSHIP", "EVENT")


@dataclass(frozen=True)
class Settings:
    blocks: BlockParams = field(default_factory=BlockParams)
    retrieval: RetrievalParams = field(default_factory=RetrievalParams)
    router: RouterParams = field(default_factory=RouterParams)
    resolution: ResolutionParams = field(default_factory=ResolutionParams)
    scoring: ScoringParams = field(default_factory=ScoringParams)
    dedup: DedupParams = field(default_factory=DedupParams)
    urls: UrlRules = field(default_factory=UrlRules)
