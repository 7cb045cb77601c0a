"""What a search service tells about itself: health, metrics, the overview of a dashboard, growth."""

from __future__ import annotations

import os
import resource
import threading
import time

from pyspark.sql import SparkSession

from seekspark import __version__
from seekspark.config import GrowthConfig, SearchConfig
from seekspark.errors import EngineError
from seekspark.operators import analytics
from seekspark.operators.engine import SearchEngine, SearchIndex
from seekspark.sources.tables import StateFile, Timeline, spool_backlog


def process_metrics() -> dict:
    """Of the driver's Python: memory at most, CPU seconds, threads, and the process itself."""
    used = resource.getrusage(resource.RUSAGE_SELF)
    return {"pid": os.getpid(), "max_rss_bytes": used.ru_maxrss * 1024, "cpu_seconds": used.ru_utime + used.ru_stime, "threads": threading.active_count()}


class Service:
    """An index that may not be there yet, its query log, and the state that crawler and indexer publish."""

    def __init__(self, spark: SparkSession, index: str, spool: str | None = None, crawl_stats: str | None = None, config: SearchConfig = SearchConfig(), clock=time.time):
        self.spark, self.path, self.spool, self.config, self.clock = spark, index.rstrip("/"), spool, config, clock
        self.crawl_stats = StateFile(spark, crawl_stats) if crawl_stats else None
        self.timeline = Timeline(spark, f"{self.path}/history.json")
        self.began, self._engine, self._why = clock(), None, None

    def engine(self) -> SearchEngine:
        """Opened when it is first wanted; an error while there is no index."""
        if self._engine is None:
            try:
                self._engine = SearchEngine(SearchIndex.open(self.spark, self.path, self.config), self.config)
                self._why = None
            except EngineError as e:
                self._why = f"{type(e).__name__}: {e}"
                raise
        return self._engine

    def _open(self) -> SearchEngine | None:
        try:
            return self.engine()
        except EngineError:
            return None

    def search(self, q: str, limit: int = 10, offset: int = 0, now: float | None = None):
        return self.engine().search(q, limit, offset, now)

    def health(self) -> dict:
        """Never an error: a service without an index is degraded, and says why."""
        opened = self._open() is not None
        return {"status": "ok" if opened else "degraded", "version": __version__, "index_open": opened, "detail": None if opened else self._why}

    def index_stats(self) -> dict | None:
        engine = self._open()
        return engine.index.stats() if engine else None

    def metrics(self) -> dict:
        return {"process": process_metrics(), "index": self.index_stats()}

    def _crawler(self) -> dict | None:
        state = self.crawl_stats.read() if self.crawl_stats else None
        if state is None:
            return None
        from seekspark.sources.tables import CRAWL_FIELDS

        known = {k: state[k] for k in CRAWL_FIELDS if state.get(k) is not None}
        age = max(self.clock() - known["updated_at"], 0.0) if "updated_at" in known else None
        return known | {"age_seconds": age, "stale": age is None or age > 10.0}

    def overview(self) -> dict:
        """All that a dashboard shows, at once."""
        engine, now = self._open(), self.clock()
        queries = None
        if engine:
            log = engine.queries()
            queries = analytics.snapshot(log, max(now - self.began, 1e-9)).first().asDict() | {"total_recorded": engine.recorded} | analytics.latency(log).first().asDict()
            queries |= {"top": [r.asDict() for r in analytics.top_queries(log).collect()], "slowest": [r.asDict() for r in analytics.slowest(log).collect()], "recent": [r.asDict() for r in analytics.recent(log).collect()]}
        spool = spool_backlog(self.spark, self.spool) if self.spool else None
        return {"generated_at": now, "index": self.index_stats(), "crawler": self._crawler(), "spool": spool, "queries": queries, "process": process_metrics()}

    def growth(self, c: GrowthConfig = GrowthConfig()) -> dict:
        """The growth of the index by its timeline; before the first drain, that there is none."""
        state = self.timeline.read()
        if state is None:
            return {"available": False, "path": self.timeline.file.path}
        now, updated = self.clock(), state["updated_at"]
        age = max(now - updated, 0.0)
        figures = analytics.growth_figures(self.timeline.buckets(), updated, int(now), c=c).first().asDict()
        idle = age > c.idle_after_s
        return {"available": True, "updated_at": updated, "age_seconds": age, "total_documents": state["total_documents"], "buckets": state["buckets"]} | figures | {"idle": idle} | ({"projected_hour": 0} if idle else {})

    def reset(self) -> None:
        """Forget the query log; nothing else."""
        if self._engine:
            self._engine.reset()
