"""The link graph: edges, PageRank, authority of pages and hosts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seekspark.config import GraphConfig
from seekspark.functions.urls import graph_host
from seekspark.sources.tables import durable


def squash(value: Column, scale: float) -> Column:
    """From 0 up to, never reaching, 1; 0 for nothing or a scale that isn't above zero."""
    if scale <= 0:
        return F.lit(0.0)
    return F.when(value <= 0, 0.0).otherwise(1 - F.exp(-value / scale))


def link_edges(pages: DataFrame, url: str = "url", links: str = "links", seq: str | None = None) -> DataFrame:
    """(src, dst): the distinct links of each page, none to itself; of several records of a page the last by ``seq`` counts."""
    if seq is not None:
        pages = pages.withColumn("__n", F.row_number().over(Window.partitionBy(url).orderBy(F.desc(seq)))).filter("__n = 1")
    return pages.select(F.col(url).alias("src"), F.explode(F.array_distinct(links)).alias("dst")).filter("src <> dst").distinct()


def nodes_of(edges: DataFrame, pages: DataFrame | None = None, url: str = "url") -> DataFrame:
    """(node): everything that links, is linked, or is a page."""
    both = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return (both if pages is None else both.union(pages.select(url))).distinct()


def host_inlinks(edges: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(host, inlinks): links from pages of other hosts, added to earlier totals."""
    cross = edges.select(graph_host(F.col("src")).alias("a"), graph_host(F.col("dst")).alias("host")).filter("a <> host")
    now = cross.groupBy("host").agg(F.count("*").alias("inlinks"))
    return now if previous is None else now.union(previous.select("host", "inlinks")).groupBy("host").agg(F.sum("inlinks").alias("inlinks"))


def host_authority(inlinks: DataFrame, scale: float = 8.0) -> DataFrame:
    return inlinks.select("host", "inlinks", squash(F.col("inlinks"), scale).alias("host_authority"))


def _kernel(nodes: DataFrame, edges: DataFrame, c: GraphConfig) -> DataFrame:
    """All iterations in one task, for graphs of a checked size."""
    rows = nodes.select(F.col("node").alias("a"), F.lit(None).cast("string").alias("b")).union(edges.select("src", "dst"))

    def run(_: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(batch.loc[batch["b"].isna(), "a"].to_numpy(object))
        links = batch[batch["b"].notna()]
        src, dst = np.searchsorted(names, links["a"].to_numpy(object)), np.searchsorted(names, links["b"].to_numpy(object))
        n, out = len(names), np.bincount(src, minlength=len(names))
        rank = np.full(n, 1.0 / n)
        for _ in range(c.iterations):
            passed = np.bincount(dst, rank[src] / out[src], n)
            rank = (1 - c.damping) / n + c.damping * (passed + rank[out == 0].sum() / n)
        return pd.DataFrame({"node": names, "rank": rank})

    kind = nodes.schema["node"].dataType.simpleString()
    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, f"node {kind}, rank double")


def _joined(nodes: DataFrame, edges: DataFrame, c: GraphConfig, n: int) -> DataFrame:
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    weighed = durable(edges.join(degree, "src").select("src", "dst", "degree"))
    known = durable(nodes.join(degree.withColumnRenamed("src", "node"), "node", "left"))
    ranks = known.select("node", "degree", F.lit(1.0 / n).alias("rank"))
    for i in range(1, c.iterations + 1):
        passed = weighed.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("passed"))
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        new = (1 - c.damping) / n + c.damping * (F.coalesce("passed", F.lit(0.0)) + F.col("loose") / n)
        ranks = known.join(passed.withColumnRenamed("dst", "node"), "node", "left").join(F.broadcast(loose)).select("node", "degree", new.alias("rank"))  # one row
        if i % 5 == 0:
            ranks = durable(ranks)
    return ranks.select("node", "rank")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, c: GraphConfig = GraphConfig(), distributed: bool | None = None) -> DataFrame:
    """(node, rank) after a fixed number of iterations, ranks of dead ends spread over all nodes; they sum to 1.

    Both sizes are counted first: a graph within the limits of ``c`` goes to one task, any other runs as joins.
    """
    nodes = durable(nodes_of(edges) if nodes is None else nodes.distinct())
    edges = durable(edges.select("src", "dst").distinct())
    n = nodes.count()
    if distributed is None:
        distributed = n > c.kernel_nodes or edges.count() > c.kernel_edges
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    return _joined(nodes, edges, c, n) if distributed else _kernel(nodes, edges, c)


def authority(edges: DataFrame, nodes: DataFrame | None = None, previous: DataFrame | None = None, c: GraphConfig = GraphConfig()) -> DataFrame:
    """(url, authority, host_authority) of every node, each from 0 to 1, relative to this graph."""
    ranks = pagerank(edges, nodes, c)
    n = ranks.count()
    hosts = host_authority(host_inlinks(edges, previous), c.host_scale)
    scored = ranks.select(F.col("node").alias("url"), graph_host(F.col("node")).alias("host"), squash(F.col("rank") * n, c.authority_scale).alias("authority"))
    return scored.join(hosts.select("host", "host_authority"), "host", "left").select("url", "authority", F.coalesce("host_authority", F.lit(0.0)).alias("host_authority"))


def with_scores(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """``docs`` with authority and host_authority by URL; 0 where there is none."""
    own = scores.select("url", "authority", "host_authority")
    out = docs.drop("authority", "host_authority").join(own, "url", "left")
    return out.withColumn("authority", F.coalesce("authority", F.lit(0.0))).withColumn("host_authority", F.coalesce("host_authority", F.lit(0.0)))


def shape(edges: DataFrame, max_nodes: int = 250_000, max_edges: int = 2_000_000) -> DataFrame:
    """One row: nodes, edges, and whether a graph bounded by these limits would be cut. Nothing is cut here."""
    e = edges.agg(F.count("*").alias("edges"))
    n = nodes_of(edges).agg(F.count("*").alias("nodes"))
    return n.join(F.broadcast(e)).withColumn("over_limit", (F.col("nodes") > max_nodes) | (F.col("edges") > max_edges))
