"""Constants of the engine, each with the unit it is in."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RankingConfig:
    half_life_days: float = 30.0
    max_per_domain: int | None = 2
    authority_weight: float = 2.5
    host_authority_weight: float = 1.5
    #: What the two authorities are shares of: 1 where they come as shares.
    authority_of: float = 1.0
    host_authority_of: float = 1.0
    title_weight: float = 2.0
    legal_penalty: float = 0.3
    locale_penalty: float = 0.55
    search_view_penalty: float = 0.3
    depth_decay: float = 0.93
    depth_floor: float = 0.55
    home_bonus: float = 1.15
    site_root_weight: float = 8.0
    site_host_weight: float = 1.2


@dataclass(frozen=True)
class SearchConfig:
    k1: float = 1.2
    b: float = 0.75
    max_limit: int = 100
    max_query_chars: int = 512
    snippet_chars: int = 240
    cache_entries: int = 512
    least_candidates: int = 150
    most_candidates: int = 400
    candidate_factor: int = 4
    ranking_enabled: bool = True
    ranking: RankingConfig = field(default_factory=RankingConfig)


@dataclass(frozen=True)
class GraphConfig:
    damping: float = 0.85
    iterations: int = 20
    authority_scale: float = 4.0
    host_scale: float = 8.0
    #: Up to these sizes one task runs the iterations; beyond, DataFrame joins do.
    kernel_nodes: int = 250_000
    kernel_edges: int = 2_000_000


@dataclass(frozen=True)
class CrawlConfig:
    max_depth: int = 3
    politeness_ms: int = 1000
    in_flight_per_host: int = 2
    in_flight: int = 32
    robots_ttl_s: int = 24 * 3600
    robots_failed_ttl_s: int = 300
    backoff_base_ms: int = 250
    backoff_cap_ms: int = 30_000


@dataclass(frozen=True)
class GrowthConfig:
    bucket_s: int = 60
    retained: int = 180
    hour_s: int = 3600
    quarter_s: int = 900
    idle_after_s: int = 900
