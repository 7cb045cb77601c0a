"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm._shared import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges``; a root is the least node of its component.

    Each round points every larger neighbour of a node at the node's least neighbour, then every node and its smaller neighbours
    at the least of them, until nothing changes: a number of rounds that grows as the logarithm of the table. All steps are
    partial aggregations and equi-joins, so a hub costs no more than its links. An empty table gives no rows. Links with a null
    end and from a node to itself are left out; the latter's node, if it has no other link, is not listed.
    """
    links = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    count = links.count()
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        new = durable(large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct())
        # Settled when the table is the same as before.
        same = new.count() == count and new.join(links, ["u", "v"], "left_anti").isEmpty()
        links, count = new, new.count()
        if same:
            break
    return links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
