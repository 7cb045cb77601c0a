"""Query-log figures and the growth of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seekspark.config import GrowthConfig

SLICES, SLICE_S = 30, 10


def retained(log: DataFrame, most: int = 512) -> DataFrame:
    """The last records by ``seq``; 0 keeps none."""
    return log.orderBy(F.desc("seq")).limit(most) if most else log.limit(0)


def snapshot(log: DataFrame, uptime_s: float, most: int | None = None) -> DataFrame:
    """One row of totals over the retained records, and how many were ever recorded."""
    kept = log if most is None else retained(log, most)
    total = log.agg(F.count("*").alias("total_recorded"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    agg = kept.agg(
        F.count("*").alias("retained"), F.count_if("cached").alias("cached"), F.count_if("failed").alias("failed"),
        F.coalesce(F.sum("total_matches"), F.lit(0)).alias("matches"), F.coalesce(F.sum("returned"), F.lit(0)).alias("returned"),
    )
    return agg.join(F.broadcast(total)).withColumn("cache_hit_rate", rate(F.col("cached"), F.col("retained"))).withColumn("qps", F.col("retained") / F.lit(max(uptime_s, 1e-9)))


def nearest_rank(df: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """One row: for each fraction the value at rank round(fraction * n), halves to even, within 1..n; NULL without rows.

    Ranks come from a histogram of the values, so nothing but distinct values is ordered.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    parts = counts.repartitionByRange(value).withColumn("p", F.spark_partition_id())
    before = parts.groupBy("p").agg(F.sum("n").alias("pn")).withColumn("before", F.sum("pn").over(Window.orderBy("p")) - F.col("pn"))
    upto = parts.join(F.broadcast(before.select("p", "before")), "p").withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy(value)) + F.col("before"))  # a row a partition
    total = counts.agg(F.sum("n").alias("total"))
    ranked = upto.join(F.broadcast(total))
    rank = lambda f: F.greatest(F.lit(1), F.least(F.bround(F.lit(f) * F.col("total"), 0), F.col("total")))
    return ranked.agg(*(F.min(F.when(F.col("upto") >= rank(f), F.col(value))).alias(name) for name, f in fractions.items()))


def latency(log: DataFrame) -> DataFrame:
    """Mean, median, 95th percentile and maximum of the queries that didn't fail."""
    good = log.filter(~F.col("failed"))
    return good.agg(F.avg("took_ms").alias("mean_ms"), F.max("took_ms").alias("max_ms")).join(F.broadcast(nearest_rank(good, "took_ms", {"p50_ms": 0.5, "p95_ms": 0.95})))


def top_queries(log: DataFrame, n: int = 10) -> DataFrame:
    return log.groupBy("query").agg(F.count("*").alias("count"), F.min("seq").alias("first_seq")).orderBy(F.desc("count"), "first_seq").limit(n)


def slowest(log: DataFrame, n: int = 5) -> DataFrame:
    return log.orderBy(F.desc("took_ms"), "seq").limit(n)


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n)


def series(log: DataFrame, now: float, slices: int = SLICES, width: int = SLICE_S) -> DataFrame:
    """(idx, at, count, mean_ms, max_ms) of dense slices that end at ``now``; records outside are left out, failed ones aren't."""
    start = now - slices * width
    placed = log.withColumn("idx", F.floor((F.col("at") - F.lit(float(start))) / width)).filter(f"idx >= 0 AND idx < {slices}")
    got = placed.groupBy("idx").agg(F.count("*").alias("count"), F.avg("took_ms").alias("mean_ms"), F.max("took_ms").alias("max_ms"))
    spine = log.sparkSession.range(slices).select(F.col("id").alias("idx"))
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return spine.join(got, "idx", "left").select("idx", (F.lit(float(start)) + (F.col("idx") + 1) * width).alias("at"), zero("count", 0), zero("mean_ms", 0.0), zero("max_ms", 0.0))


def bucket_start(seconds: Column, width: int = 60) -> Column:
    """Start of the bucket, also before 1970."""
    return seconds - F.pmod(seconds, F.lit(width))


def growth_buckets(gains: DataFrame, at: str = "at", gained: str = "gained", c: GrowthConfig = GrowthConfig()) -> DataFrame:
    """(at, documents): net gains, none below 0, summed by minute; the last ``retained`` buckets."""
    each = gains.groupBy(bucket_start(F.col(at).cast("long"), c.bucket_s).alias("at")).agg(F.sum(F.greatest(F.col(gained), F.lit(0))).cast("long").alias("documents"))
    return each.orderBy(F.desc("at")).limit(c.retained)


def growth_figures(buckets: DataFrame, reference: int, now: int, total: int | None = None, c: GrowthConfig = GrowthConfig()) -> DataFrame:
    """One row: documents of the last hour and quarter, rate a minute, projection for an hour, whether growth stands still."""
    since = lambda s: F.coalesce(F.sum(F.when(F.col("at") >= reference - s, F.col("documents"))), F.lit(0)).cast("long")
    out = buckets.agg(since(c.hour_s).alias("last_hour"), since(c.quarter_s).alias("last_quarter"))
    rate = F.col("last_quarter") / (c.quarter_s / 60)
    return out.withColumn("per_minute", rate).withColumn("projected_hour", F.floor(rate * 60).cast("long")).withColumn("idle", F.lit(now - reference > c.idle_after_s))


def growth_series(buckets: DataFrame, now: int, minutes: int = 60) -> DataFrame:
    """(at, documents, percent) of dense minutes that end with the current one; percent of the highest."""
    last = now - now % 60
    spine = buckets.sparkSession.range(minutes).select((F.lit(last) - (minutes - 1 - F.col("id")) * 60).alias("at"))
    dense = spine.join(buckets, "at", "left").select("at", F.coalesce("documents", F.lit(0)).alias("documents"))
    peak = F.max("documents").over(Window.partitionBy())  # as many rows as minutes
    return dense.withColumn("percent", F.when(peak > 0, F.round(F.col("documents") * 100.0 / peak, 2)).otherwise(0.0))


def crawl_age(updated_at: Column, now: float, stale_after: float = 10.0) -> Column:
    age = F.greatest(F.lit(now) - updated_at, F.lit(0.0))
    return F.struct(age.alias("age_s"), F.coalesce(age > stale_after, F.lit(True)).alias("stale"))


def crawl_counters(outcomes: DataFrame) -> DataFrame:
    """One row of the nine counts of a crawl over a table of outcomes: links (kind ``link``: off_site, asset, fresh) and visits (``page``, ``sitemap``, ``disallowed``, ``failed``: redirected, dropped).

    A link that leaves the scope or leads to an asset is skipped; a fresh other one is queued. A page is fetched, and indexed unless
    it was dropped for where it was redirected to.
    """
    kind, off, asset = F.col("kind"), F.coalesce("off_site", F.lit(False)), F.coalesce("asset", F.lit(False))
    link, page = kind == "link", kind == "page"
    dropped = F.coalesce("dropped", F.lit(False))
    return outcomes.agg(
        F.count_if(link & ~off & ~asset & F.coalesce("fresh", F.lit(False))).alias("queued"), F.count_if(page & ~dropped).alias("fetched"), F.count_if(page & ~dropped).alias("indexed"),
        F.count_if(kind == "failed").alias("failed"), F.count_if(kind == "disallowed").alias("disallowed"), F.count_if((kind == "sitemap") & ~dropped).alias("sitemaps"),
        F.count_if(link & off).alias("skipped_offsite"), F.count_if(link & ~off & asset).alias("skipped_assets"), F.count_if(F.coalesce("redirected", F.lit(False))).alias("redirected_offsite"),
    )
