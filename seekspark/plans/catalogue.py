"""The registered queries and their SQL twins, gathered from the modules beside this one."""

from __future__ import annotations

from seekspark.plans import analytics_queries, crawl_queries, search_queries, url_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (url_queries, crawl_queries, search_queries, analytics_queries):
    QUERIES |= _module.REGISTRY.queries
    ORACLES |= _module.REGISTRY.oracles
