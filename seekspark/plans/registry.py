"""Registration of a query with its SQL twin, and the derived inputs that both sides build alike."""

from __future__ import annotations

import gzip
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a function (spark, sf_dir) -> DataFrame under its name; integers come out as longs."""

        def add(f):
            def run(spark, sf_dir: str) -> DataFrame:
                return longs(f(spark, sf_dir))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = run
            if sql is not None:
                self.oracles[f.__name__] = sql
            return run

        return add


def longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes))


def values(rows: list[tuple], names: str) -> str:
    """A SQL VALUES list that both engines read."""

    def one(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names}))"


def names(items) -> str:
    return ", ".join(f"'{x}'" for x in sorted(items))


#: Edges between pages, as no link of the sample pages leads to another of them.
EDGES_SQL = """(SELECT DISTINCT s.url AS src, d.url AS dst FROM pages s, (SELECT count(*) AS n FROM pages) c, pages d
    WHERE d.page_id IN ((s.page_id * 7 + 3) % c.n, (s.page_id * s.page_id + 1) % c.n, s.page_id // 3) AND s.url <> d.url)"""
NOW = 1_700_000_000
FETCHED_SQL = f"({NOW} - (page_id % 120) * 86400)"
QLOG_SQL = """(SELECT event_id AS seq, event_type AS query, value AS took_ms, CAST(json_extract(props, '$.k') AS BIGINT) AS total_matches,
    least(CAST(json_extract(props, '$.k') AS BIGINT), 10) AS returned, user_id % 2 = 0 AS cached, event_type = 'error' AS failed, CAST(floor(epoch(ts)) AS BIGINT) AS "at" FROM events)"""


def page_edges(pages: DataFrame) -> DataFrame:
    """The same edges by equi-joins."""
    n = pages.count()
    i = F.col("page_id")
    aims = pages.select(F.col("url").alias("src"), F.explode(F.array((i * 7 + 3) % n, (i * i + 1) % n, F.floor(i / 3))).alias("aim"))
    return aims.join(pages.select(F.col("page_id").alias("aim"), F.col("url").alias("dst")), "aim").filter("src <> dst").select("src", "dst").distinct()


def fetched_at():
    return F.lit(NOW) - (F.col("page_id") % 120) * 86400


def query_log(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("query"), F.col("value").alias("took_ms"), k.alias("total_matches"), F.least(k, F.lit(10).cast("long")).alias("returned"),
        (F.col("user_id") % 2 == 0).alias("cached"), (F.col("event_type") == "error").alias("failed"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"),
    )


@F.pandas_udf(T.BinaryType())
def gzipped(text: pd.Series) -> pd.Series:
    """Texts as a server may send them; for inputs of queries."""
    return text.map(lambda t: gzip.compress(t.encode(), mtime=0), na_action="ignore")
