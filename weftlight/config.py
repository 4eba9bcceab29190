"""Settings of a crawl and its search, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Pass one to callers that read several settings; operators take them as parameters."""

    max_depth: int = 3
    concurrent_requests: int = 5
    default_crawl_delay: float = 0.2
    seed_priority: int = 10
    recrawl_priority: int = 5
    heartbeat_ttl_s: int = 15
    robots_ttl_s: int = 3600
    damping: float = 0.85
    max_iterations: int = 50
    tolerance: float = 1e-6
    candidates: int = 50
    results: int = 20
    encoded_characters: int = 800
