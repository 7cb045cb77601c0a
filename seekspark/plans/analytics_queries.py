"""The query log and the growth of the index, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekspark.operators import analytics
from seekspark.plans.registry import QLOG_SQL, Registry, query_log
from seekspark.sources.tables import table

REGISTRY = Registry()
_NOW = '(SELECT max("at") + 1 FROM q)'
_Q = f"WITH q AS MATERIALIZED (SELECT * FROM {QLOG_SQL})"


def log(spark, sf_dir):
    return query_log(table(spark, sf_dir, "events"))


@REGISTRY.query(_Q + """ SELECT count(*)::BIGINT AS retained, (SELECT count(*) FROM q)::BIGINT AS total_recorded, count(*) FILTER (cached)::BIGINT AS cached, count(*) FILTER (failed)::BIGINT AS failed, sum(total_matches)::BIGINT AS matches, sum(returned)::BIGINT AS returned,
    round(count(*) FILTER (cached) / count(*), 6) AS cache_hit_rate, round(count(*) / 100.0, 6)::DOUBLE AS qps FROM (SELECT * FROM q ORDER BY seq DESC LIMIT 512)""")
def q_qlog_snapshot(spark, sf_dir):
    out = analytics.snapshot(log(spark, sf_dir), 100.0, 512)
    return out.withColumn("cache_hit_rate", F.round("cache_hit_rate", 6)).withColumn("qps", F.round("qps", 6))


_RANK = lambda f: f"greatest(1, least(round_even({f} * (SELECT count(*) FROM g), 0), (SELECT count(*) FROM g)))"


@REGISTRY.query(_Q + f""", g AS MATERIALIZED (SELECT took_ms, row_number() OVER (ORDER BY took_ms) AS r FROM q WHERE NOT failed) SELECT round(avg(took_ms), 6) AS mean_ms, round(max(took_ms), 6) AS max_ms,
    round(max(took_ms) FILTER (r = {_RANK(0.5)}), 6) AS p50_ms, round(max(took_ms) FILTER (r = {_RANK(0.95)}), 6) AS p95_ms FROM g""")
def q_latency(spark, sf_dir):
    out = analytics.latency(log(spark, sf_dir))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@REGISTRY.query(_Q + " SELECT query, count(*)::BIGINT AS count, min(seq)::BIGINT AS first_seq FROM q GROUP BY query ORDER BY count DESC, first_seq LIMIT 10")
def q_top_queries(spark, sf_dir):
    return analytics.top_queries(log(spark, sf_dir))


@REGISTRY.query(_Q + " SELECT seq, query, round(took_ms, 6) AS took_ms, failed FROM q ORDER BY q.took_ms DESC, seq LIMIT 5")
def q_slowest(spark, sf_dir):
    return analytics.slowest(log(spark, sf_dir)).select("seq", "query", F.round("took_ms", 6).alias("took_ms"), "failed")


@REGISTRY.query(_Q + ' SELECT seq, query, "at" FROM q ORDER BY seq DESC LIMIT 20')
def q_recent(spark, sf_dir):
    return analytics.recent(log(spark, sf_dir)).select("seq", "query", "at")


@REGISTRY.query(_Q + f""", s AS (SELECT i::BIGINT AS idx FROM range(30) t(i)), g AS (SELECT floor(("at" - ({_NOW} - 108000)) / 3600)::BIGINT AS idx, count(*) AS n, avg(took_ms) AS mean, max(took_ms) AS most FROM q GROUP BY 1)
    SELECT idx, ({_NOW} - 108000 + (idx + 1) * 3600)::DOUBLE AS "at", coalesce(n, 0)::BIGINT AS count, round(coalesce(mean, 0), 6) AS mean_ms, round(coalesce(most, 0), 6) AS max_ms FROM s LEFT JOIN g USING (idx)""")
def q_series(spark, sf_dir):
    """Dense slices of an hour, as the sample's events lie hours apart."""
    rows = log(spark, sf_dir)
    out = analytics.series(rows, rows.agg(F.max("at")).first()[0] + 1, 30, 3600)
    return out.withColumn("mean_ms", F.round("mean_ms", 6)).withColumn("max_ms", F.round("max_ms", 6))


_GAINS = '(SELECT CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 60 AS "at", sum(greatest(CASE WHEN event_id % 9 = 0 THEN -1 ELSE 1 END, 0))::BIGINT AS documents FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 180)'
_LAST = "(SELECT CAST(floor(max(epoch(ts))) AS BIGINT) FROM events)"


def _buckets(spark, sf_dir):
    gains = table(spark, sf_dir, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.when(F.col("event_id") % 9 == 0, -1).otherwise(1).alias("gained"))
    return analytics.growth_buckets(gains), gains.agg(F.max("at")).first()[0]


@REGISTRY.query(f"SELECT * FROM {_GAINS}")
def q_growth_buckets(spark, sf_dir):
    return _buckets(spark, sf_dir)[0]


@REGISTRY.query(f"""SELECT *, round(last_quarter / 15, 6) AS per_minute, floor(last_quarter / 15 * 60)::BIGINT AS projected_hour, true AS idle FROM (SELECT coalesce(sum(documents) FILTER ("at" >= {_LAST} - 3600), 0)::BIGINT AS last_hour, coalesce(sum(documents) FILTER ("at" >= {_LAST} - 900), 0)::BIGINT AS last_quarter FROM {_GAINS})""")
def q_growth_figures(spark, sf_dir):
    buckets, last = _buckets(spark, sf_dir)
    return analytics.growth_figures(buckets, last, last + 1000).withColumn("per_minute", F.round("per_minute", 6))


@REGISTRY.query(f"""SELECT "at", documents, CASE WHEN peak > 0 THEN round(documents * 100.0 / peak, 2) ELSE 0 END::DOUBLE AS percent FROM (SELECT *, max(documents) OVER () AS peak FROM (SELECT "at", coalesce(documents, 0)::BIGINT AS documents
    FROM (SELECT {_LAST} - {_LAST} % 60 - i * 60 AS "at" FROM range(60) t(i)) LEFT JOIN {_GAINS} USING ("at")))""")
def q_growth_dense(spark, sf_dir):
    buckets, last = _buckets(spark, sf_dir)
    return analytics.growth_series(buckets, last)


@REGISTRY.query('SELECT CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 60 AS "at", count(*)::BIGINT AS documents FROM events GROUP BY 1')
def q_stream_growth(spark, sf_dir):
    """Minute windows of a stream of the events, read in small files."""
    from seekspark.streaming import growth

    return growth.replayed(spark, f"{sf_dir}/events.parquet")


@REGISTRY.query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def q_stream_drain(spark, sf_dir):
    """Keyed updates that arrive in segments and are upserted batch by batch."""
    from seekspark.streaming import drain

    return drain.replayed(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@REGISTRY.query("SELECT user_id, count(*)::BIGINT AS events, max(value) AS highest FROM events GROUP BY user_id")
def q_stream_state(spark, sf_dir):
    """A figure kept for each key by a stateful stream."""
    from seekspark.streaming import growth

    return growth.per_key(spark, f"{sf_dir}/events.parquet")


@REGISTRY.query('SELECT (d * 86400)::BIGINT AS "at", n::BIGINT AS documents FROM (SELECT CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS d, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 20)')
def q_timeline(spark, sf_dir):
    """The events of each day recorded in a timeline file, each day in two goes, the second of them twice; the last twenty days are kept."""
    from seekspark.sources.tables import Timeline
    from seekspark.streaming.folders import new_folder

    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)
    days = table(spark, sf_dir, "events").groupBy(day.alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()  # a row a day
    line = Timeline(spark, f"{new_folder(spark, 'timeline')}/history.json", retained=20, bucket_s=86400)
    for r in days:
        line.record(r["d"] * 86400 + 5, 1, 0, f"{r['d']} a")
        for _ in range(2):
            line.record(r["d"] * 86400 + 9, r["n"] - 1, 0, f"{r['d']} b")
    return line.buckets()


@REGISTRY.query("SELECT DISTINCT user_id FROM events")
def q_stream_seen(spark, sf_dir):
    """Each user once, of a stream of events."""
    from seekspark.streaming import growth

    return growth.seen_once(spark, f"{sf_dir}/events.parquet", "user_id")


@REGISTRY.query("SELECT event_id, CASE WHEN b < 1024 THEN b || chr(160) || 'B' WHEN b < 10240 THEN printf('%.1f', b / 1024) || chr(160) || 'KB' WHEN b < 1048576 THEN printf('%.0f', b / 1024) || chr(160) || 'KB' ELSE printf('%.1f', b / 1048576) || chr(160) || 'MB' END AS size, CASE WHEN s < 60 THEN s || chr(160) || 's' WHEN s < 3600 THEN s // 60 || chr(160) || 'min ' || lpad((s % 60)::VARCHAR, 2, '0') || chr(160) || 's' WHEN s < 86400 THEN s // 3600 || chr(160) || 'h ' || s % 3600 // 60 || chr(160) || 'min' ELSE s // 86400 || chr(160) || 'd' END AS lasted FROM (SELECT event_id, (event_id * 104729 % 5000000) // 128 * 128 + 1 AS b, event_id * 7919 % 300000 AS s FROM events) WHERE b % 512 > 0")
def q_sizes(spark, sf_dir):
    """Bytes and durations in words."""
    from seekspark.functions import phrases

    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", (F.floor(i * 104729 % 5000000 / 128) * 128 + 1).alias("b"), (i * 7919 % 300000).alias("s"))
    return rows.select("event_id", phrases.format_bytes(F.col("b")).alias("size"), phrases.format_duration(F.col("s")).alias("lasted"))
