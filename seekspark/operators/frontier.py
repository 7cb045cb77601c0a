"""The crawl frontier as tables: scheduling links, one head per host, politeness, seed lists."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seekspark.functions import urls


#: The depth at which the pages that a sitemap lists, and the sitemaps that robots.txt names, enter the frontier.
SITEMAP_DEPTH, ROBOTS_SITEMAP_DEPTH = 1, 0


def in_scope(links: DataFrame, scope: DataFrame | None) -> DataFrame:
    """``links`` (host ...) of the hosts of ``scope``; None is everywhere."""
    return links if scope is None else links.join(scope.select("host").distinct(), "host", "left_semi")


def unseen(links: DataFrame, seen: DataFrame | None) -> DataFrame:
    """``links`` (url ...) whose URLs aren't in ``seen``."""
    return links if seen is None else links.join(seen.select("url"), "url", "left_anti")


def _judged(links: DataFrame, scope: DataFrame | None, max_depth: int) -> DataFrame:
    """Canonical links that are followed, with their host and whether they leave the scope or lead to an asset."""
    # Behind a generator a long expression is evaluated once; filters that were pushed below it would repeat it many times over.
    canonical = F.explode(F.array(urls.canonical_url(F.col("url")))).alias("url")
    found = links.filter(F.col("depth") < max_depth).select(canonical, (F.col("depth") + 1).alias("depth"), "seq").filter("url IS NOT NULL")
    found = found.withColumn("host", urls.crawl_host(F.col("url"))).withColumn("asset", ~urls.is_probably_page(F.col("url")))
    if scope is None:
        return found.withColumn("off_site", F.lit(False))
    known = scope.select("host", F.lit(True).alias("__in")).distinct()
    return found.join(known, "host", "left").withColumn("off_site", F.col("__in").isNull()).drop("__in")


def schedule(links: DataFrame, seen: DataFrame | None = None, scope: DataFrame | None = None, max_depth: int = 3) -> DataFrame:
    """Jobs (url, host, depth) for the links (url, depth) of fetched pages, in order of ``seq``.

    Canonical web URLs inside the scope's hosts (None: everywhere), no assets, not seen before, each once; a page at
    ``max_depth`` has its links left alone.
    """
    found = _judged(links, scope, max_depth).filter("NOT off_site AND NOT asset")
    once = found.groupBy("url", "host").agg(F.min(F.struct("seq", "depth")).alias("f")).select("url", "host", "f.depth", "f.seq")
    return unseen(once, seen)


def schedule_counters(links: DataFrame, seen: DataFrame | None = None, scope: DataFrame | None = None, max_depth: int = 3) -> DataFrame:
    """One row of what :func:`schedule` does with the same links: off-site links and assets by occurrence, and jobs queued."""
    judged = _judged(links, scope, max_depth)
    left = judged.agg(F.count_if("off_site").alias("skipped_offsite"), F.count_if(F.expr("NOT off_site AND asset")).alias("skipped_assets"))
    return left.join(F.broadcast(schedule(links, seen, scope, max_depth).agg(F.count("*").alias("queued"))))  # one row each


def sitemap_jobs(found: DataFrame, depth: int = SITEMAP_DEPTH) -> DataFrame:
    """Links (url, depth, seq) from URLs (url, seq) that sitemaps list, such that :func:`schedule` queues them at ``depth``."""
    return found.select("url", F.lit(depth - 1).alias("depth"), "seq")


def after_redirects(visits: DataFrame, scope: DataFrame | None, drop: bool = False) -> DataFrame:
    """``visits`` (url, final_url ...) with the canonical ``final_url`` and ``redirected_offsite``: whether it lies outside a scope. With ``drop`` those go."""
    rest = [F.col(f"`{c}`") for c in visits.columns if c != "final_url"]
    final = visits.select(*rest, F.explode(F.array(urls.canonical_final_url(F.col("final_url"), F.col("url")))).alias("final_url"))
    if scope is None:
        return final.withColumn("redirected_offsite", F.lit(False))
    known = scope.select(F.col("host").alias("__host")).distinct().withColumn("__in", F.lit(True))
    out = final.join(known, urls.crawl_host(F.col("final_url")) == F.col("__host"), "left").withColumn("redirected_offsite", F.col("__in").isNull()).drop("__host", "__in")
    return out.filter("NOT redirected_offsite") if drop else out


def host_snapshot(hosts: DataFrame, limit: int) -> DataFrame:
    """The states of the first hosts by name."""
    return hosts.orderBy("host").limit(limit)


def sorted_hosts(scope: DataFrame) -> DataFrame:
    """(hosts): one row with the names in a scope, ascending, each once. A scope is a list that people write."""
    return scope.agg(F.array_sort(F.collect_set("host")).alias("hosts"))


def heads(frontier: DataFrame) -> DataFrame:
    """The oldest job of each host."""
    return frontier.groupBy("host").agg(F.min_by(F.struct(*[c for c in frontier.columns if c != "host"]), "seq").alias("j")).select("host", "j.*")


def pop_ready(frontier: DataFrame, hosts: DataFrame, now_ms: int, most: int = 32) -> DataFrame:
    """Heads of hosts that may be asked now, in order of host. A host without a state may."""
    ready = heads(frontier).join(hosts.select("host", "next_allowed_at_ms"), "host", "left").filter(F.coalesce("next_allowed_at_ms", F.lit(0)) <= now_ms)
    return ready.drop("next_allowed_at_ms").orderBy("host").limit(most)


def assign(frontier: DataFrame, per_host: int = 2, most: int = 32) -> DataFrame:
    """Jobs to run at once: the oldest of each host up to its share, in order of age up to the whole."""
    n = F.row_number().over(Window.partitionBy("host").orderBy("seq"))
    return frontier.withColumn("n", n).filter(F.col("n") <= per_host).orderBy("n", "seq").limit(most).drop("n")


def defer(hosts: DataFrame, visited: DataFrame, now_ms: int, default_ms: int = 1000) -> DataFrame:
    """Host states after visits (host, crawl_delay_s), successful or not."""
    wait = F.greatest(F.lit(default_ms).cast("long"), F.coalesce(F.max("crawl_delay_s") * 1000, F.lit(0)))
    new = visited.groupBy("host").agg((F.lit(now_ms) + wait).cast("long").alias("next_allowed_at_ms"), F.lit(now_ms).cast("long").alias("last_fetched_at_ms"))
    return hosts.join(new, "host", "left_anti").unionByName(new)


def valid_robots(jobs: DataFrame, robots: DataFrame, now_ms: int) -> DataFrame:
    """Jobs with ``known``: whether their host's rules are still within their time to live."""
    live = robots.filter(F.lit(now_ms) - F.col("fetched_at_ms") <= F.col("ttl_ms")).select("host", F.lit(True).alias("known"))
    return jobs.join(live, "host", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def interleave(seeds: DataFrame, limit: int) -> DataFrame:
    """(place, url, site) of a seed list that takes sites in turn: first each one's share, then the rest; a URL counts where it comes first."""
    ranked = seeds.withColumn("depth", F.row_number().over(Window.partitionBy("site").orderBy("seq")) - 1)
    sites = seeds.groupBy("site").agg(F.min("seq").alias("site_seq"))
    share = F.greatest(F.lit(8), F.ceil(F.lit(limit) / F.col("n_sites")))
    n = sites.agg(F.count("*").alias("n_sites"))
    keyed = ranked.join(sites, "site").join(F.broadcast(n)).select("url", "site", F.struct((F.col("depth") >= share).alias("late"), "depth", "site_seq").alias("at"))  # one row
    once = keyed.groupBy("url").agg(F.min(F.struct("at", "site")).alias("f")).select("url", "f.site", "f.at")
    first = once.orderBy("at").limit(limit)
    return first.withColumn("place", F.row_number().over(Window.orderBy("at"))).select("place", "url", "site")


def slices(seeds: DataFrame, n: int = 6) -> DataFrame:
    """The list cut into n runs of nearly equal length (column ``slice``)."""
    return seeds.withColumn("slice", F.ntile(n).over(Window.orderBy("place")))


def bloom_size(entries: int, false_positives: float) -> tuple[int, int, float]:
    """(bits, hash functions, MiB) of a Bloom filter; sets here are exact, the figures are for comparison."""
    bits = ceil(-entries * log(false_positives) / log(2) ** 2)
    return bits, max(1, round(bits / entries * log(2))), bits / 8 / 2**20


def crawl(pages: DataFrame, seeds: DataFrame, links: str = "links", max_depth: int = 3, budget: int | None = None) -> DataFrame:
    """(url, depth) of the pages that are reached from the seeds, level by level; the table stands in for the network."""
    from seekspark.sources.tables import durable

    level = seeds.select(urls.canonical_url(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct().withColumn("depth", F.lit(0))
    reached = durable(level.join(pages.select("url"), "url", "left_semi"))
    now = reached
    for depth in range(max_depth):
        out = now.join(pages.select("url", links), "url").select(F.explode(links).alias("url"), "depth", F.lit(0).cast("long").alias("seq"))
        now = durable(schedule(out, reached, max_depth=max_depth).select("url", "depth").join(pages.select("url"), "url", "left_semi"))
        if now.isEmpty():
            break
        reached = durable(reached.unionByName(now))
        if budget is not None and reached.count() >= budget:
            return reached.orderBy("depth", "url").limit(budget)
    return reached
