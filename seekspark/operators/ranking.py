"""Re-ranking of a pool of hits: freshness, importance, duplicates, pages with a cap for each site."""

from __future__ import annotations

from dataclasses import dataclass
from math import pow

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seekspark.config import RankingConfig
from seekspark.functions import urls
from seekspark.functions.text import title_match

NOISE = frozenset("co com http https io net org www".split())


def terms_of(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def navigational_target(terms: list[str]) -> str | None:
    """The one term left of a query without its noise words, if it is one."""
    left = [t for t in terms if t not in NOISE]
    return left[0] if len(left) == 1 else None


@F.pandas_udf(T.DoubleType())
def _halved(half_lives: pd.Series) -> pd.Series:
    """What is left after so many half-lives. Java's ``pow`` is off by a last bit in one of ten cases, and equal scores would part by it."""
    return pd.Series([pow(0.5, x) for x in half_lives], dtype="float64")


def freshness(score: Column, fetched_at: Column, now: float, half_life_days: float = 30.0) -> Column:
    if half_life_days <= 0:
        raise ValueError("a half-life is above zero")
    age = F.greatest(F.lit(0.0), (F.lit(float(now)) - fetched_at) / 86400.0)
    return score * _halved(age / float(half_life_days))


def importance(score: Column, query: str, c: RankingConfig = RankingConfig()) -> Column:
    """Text score times URL quality, plus authority, title match and what a query that names a site adds."""
    url, terms = F.col("url"), terms_of(query)
    target = navigational_target(terms)
    label, inner = urls.host_label(url), F.size(urls.path_segments(url)) > 0
    named = label.isin(*sorted(set(terms))) if terms else F.lit(False)
    nav = F.when(named & inner & (label != ""), c.site_host_weight).otherwise(0.0)
    if target is not None:
        nav = nav + F.when((label == target) & ~inner, c.site_host_weight + c.site_root_weight).otherwise(0.0)
    quality = urls.url_quality(url, c.legal_penalty, c.locale_penalty, c.search_view_penalty, c.depth_decay, c.depth_floor, c.home_bonus)
    return score * quality + c.authority_weight * F.coalesce("authority", F.lit(0.0)) / float(c.authority_of) + c.host_authority_weight * F.coalesce("host_authority", F.lit(0.0)) / float(c.host_authority_of) + c.title_weight * title_match(F.col("title"), terms) + nav


def ordered_pool(hits: DataFrame, query: str, now: float, c: RankingConfig = RankingConfig()) -> DataFrame:
    """``hits`` (url, title, snippet, fetched_at, score, authority, host_authority, engine_rank) with their final score and ``place``, duplicates collapsed.

    Equal scores keep the engine's order; of hits with one host, title and snippet the first stays. A pool is a window of at
    most some hundred hits, so one partition orders it.
    """
    fresh = hits.withColumn("score", freshness(F.col("score"), F.col("fetched_at"), now, c.half_life_days))
    weighed = fresh.withColumn("score", importance(F.col("score"), query, c))
    first = Window.partitionBy(urls.rank_host(F.col("url")), F.lower(F.trim(F.regexp_replace("title", r"(?U)\s+", " "))), "snippet").orderBy(F.desc("score"), "engine_rank")
    alone = weighed.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return alone.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "engine_rank")))


def cap_hosts(pool: DataFrame, most: int, host: str = "host") -> DataFrame:
    """The first ``most`` of each host."""
    return pool.withColumn("__n", F.row_number().over(Window.partitionBy(host).orderBy("place"))).filter(F.col("__n") <= most).drop("__n")


def rank(hits: DataFrame, query: str, now: float, c: RankingConfig = RankingConfig()) -> tuple[DataFrame, int]:
    """The ordered pool with the cap held over all of it, and how many of ``hits`` it left out, as duplicates or over the cap."""
    pool = ordered_pool(hits, query, now, c).withColumn("host", urls.rank_host(F.col("url")))
    kept = pool if c.max_per_domain is None else cap_hosts(pool, c.max_per_domain)
    return kept, hits.count() - kept.count()


def first_fit(hosts: list[str], limit: int, cap: int) -> list[tuple[int, int]]:
    """(page, slot), both from 1, of hits in their order: each goes to the first page with a free slot and under ``cap`` hits of its host.

    That is what passes over the rest give, one for each page, as a pass decides on a hit by earlier ones alone. A host's page
    only moves on and full pages are skipped, so the walk takes about one step a hit.
    """
    if limit < 1 or cap < 1:
        raise ValueError(f"limit {limit}, cap {cap}")
    filled, onward, at, own, out = [0], [0], {}, {}, []

    def free(page: int) -> int:
        """The first page from this one on that isn't full."""
        seen = []
        while page < len(filled) and filled[page] >= limit:
            seen.append(page)
            page = max(onward[page], page + 1)
        for p in seen:
            onward[p] = page
        if page == len(filled):
            filled.append(0), onward.append(page)
        return page

    for host in hosts:
        page = free(at.get(host, 0))
        if page != at.get(host, 0) or own.get(host, 0) >= cap:
            page = free(page + 1) if page == at.get(host, 0) else page
            own[host] = 0
        at[host], own[host] = page, own.get(host, 0) + 1
        filled[page] += 1
        out.append((page + 1, filled[page]))
    return out


def page_numbers(pool: DataFrame, limit: int, cap: int, host: str = "host") -> DataFrame:
    """``pool`` with ``page`` and ``slot`` of :func:`first_fit`, in order of ``place``.

    A pool is a window of hits (``SearchConfig.most_candidates``), not the corpus, so one task walks it, once.
    """
    names = pool.columns

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        found = first_fit(rows[host].tolist(), limit, cap)
        return rows[names].assign(page=[p for p, _ in found], slot=[s for _, s in found])

    schema = T.StructType([*pool.schema.fields, T.StructField("page", T.LongType()), T.StructField("slot", T.LongType())])
    return pool.groupBy(F.lit(0).alias("__all")).applyInPandas(walk, schema)


@dataclass(frozen=True)
class Page:
    hits: list
    held_back: int
    pages: int


def take_page(pool: list, limit: int | None, offset: int = 0, cap: int | None = 2) -> Page:
    """The page at ``offset // limit`` of a pool's rows in order of ``place``; ``held_back`` hits were passed over before it was full.

    Rows have a ``host``. Without a cap pages are plain slices; without a limit the cap holds over the whole pool.
    """
    if cap is None:
        return Page(pool[offset : None if limit is None else offset + limit], 0, 1 if limit is None else -(-len(pool) // limit))
    if limit is None:
        counts: dict[str, int] = {}
        kept = []
        for row in pool:
            counts[row["host"]] = counts.get(row["host"], 0) + 1
            kept += [row] * (counts[row["host"]] <= cap)
        return Page(kept, len(pool) - len(kept), 1)
    found = first_fit([row["host"] for row in pool], limit, cap)
    want = offset // limit + 1
    hits = [i for i, (page, _) in enumerate(found) if page == want]
    upto = hits[-1] if len(hits) == limit else len(pool)
    held = sum(page > want for page, _ in found[:upto]) if hits else 0
    return Page([pool[i] for i in hits], held, max((page for page, _ in found), default=0))
