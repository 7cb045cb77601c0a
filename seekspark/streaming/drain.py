"""Draining sealed segments into an index, batch by batch, and exactly once in effect."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.operators.engine import IndexWriter, latest
from seekspark.operators.graph import authority, host_inlinks, link_edges, nodes_of, with_scores
from seekspark.sources import files
from seekspark.sources.tables import StateFile, Timeline, durable
from seekspark.streaming.deltas import Deltas
from seekspark.streaming.folders import new_folder
from seekspark.streaming.growth import run_to_end


def replayed(updates: DataFrame, key: str, seq: str, segments: int = 8) -> DataFrame:
    """The table after ``updates`` came in as segments, in order, and were upserted by key. A batch writes its own changes alone, under its number, so one that runs twice changes nothing."""
    spark = updates.sparkSession
    spool, table = new_folder(spark, "spool"), Deltas(spark, new_folder(spark, "index"), key)
    updates.withColumn("__s", F.col(seq) % segments).repartition(segments, "__s").drop("__s").write.parquet(spool)

    def take(df: DataFrame, batch: int) -> None:
        new, old = latest(df, key, seq), table.read()
        if old is not None:
            # Of the keys in this batch alone: an older update that comes late doesn't win.
            new = latest(old.join(new.select(key), key, "left_semi").unionByName(new), key, seq)
        table.write(new, batch)

    run_to_end(spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 3).parquet(spool), "append", take)
    out = table.read()
    return updates.limit(0) if out is None else out.select(*updates.columns)


@dataclass
class Report:
    batches: int = 0
    documents: int = 0
    gained: int = 0
    edges: int = 0
    gains: list[tuple[int, int]] = field(default_factory=list)


class HostTotals:
    """Cross-site links by host over all batches so far, kept in a folder; a batch that runs again counts once.

    Each batch writes a table of its own beside the one before, and then points to both.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pointer = StateFile(spark, f"{self.folder}/hosts.json")

    def _table(self, name: str | None) -> DataFrame | None:
        return self.spark.read.schema("host string, inlinks long").parquet(f"{self.folder}/hosts/{name}") if name else None

    def before(self, by: str) -> DataFrame | None:
        """The totals that a batch adds to; None if there are none, or none that can be read."""
        state = self.pointer.read() or {}
        return self._table(state.get("before") if state.get("by") == by else state.get("table"))

    def record(self, edges: DataFrame, by: str) -> None:
        state, name = self.pointer.read() or {}, uuid.uuid4().hex
        old = state.get("before") if state.get("by") == by else state.get("table")
        host_inlinks(edges, self._table(old)).write.parquet(f"{self.folder}/hosts/{name}")
        self.pointer.write({"by": by, "table": name, "before": old})
        for gone in {state.get("before"), state.get("table")} - {old, None}:
            files.remove(self.spark, f"{self.folder}/hosts/{gone}")

    def read(self) -> DataFrame | None:
        return self._table((self.pointer.read() or {}).get("table"))


def drain_batch(spark: SparkSession, docs: DataFrame, writer: IndexWriter, report: Report, at: int, totals: HostTotals | None = None, timeline: Timeline | None = None, by: str = "") -> None:
    """Two passes over a batch of documents (url, title, body, fetched_at, outlinks): its link graph first, then the documents with their scores.

    Host authority counts the links of all batches so far, those of earlier drains too.
    """
    docs = docs.persist()
    edges = durable(link_edges(docs, "url", "outlinks", "fetched_at"))
    scores = authority(edges, nodes_of(edges, docs), totals.before(by) if totals else None)
    writer.add_or_update(with_scores(docs, scores))
    gained = writer.commit()
    if totals:
        totals.record(edges, by)
    if timeline:
        timeline.record(at, max(gained, 0), writer.doc_count(), by or None)
    report.batches, report.documents, report.gained, report.edges = report.batches + 1, report.documents + docs.count(), report.gained + gained, report.edges + edges.count()
    report.gains.append((at, max(gained, 0)))
    docs.unpersist()


def drain(spark: SparkSession, spool: str, index: str, checkpoint: str | None = None, files_each: int = 16, retire: str = "off", archive: str | None = None, clock=None) -> Report:
    """Index all sealed segments of a folder. Segments are retired (``delete`` or ``archive``) only after the batch that held them is committed.

    A batch is one commit, so ``files_each`` segments of bounded size are what waits at most. Host totals and the growth timeline
    lie beside the index and are carried on by the next drain.
    """
    import time

    writer, report = IndexWriter(spark, index), Report()
    checkpoint = checkpoint or new_folder(spark, "drain")
    totals, timeline = HostTotals(spark, f"{writer.path}/graph"), Timeline(spark, f"{writer.path}/history.json")
    reader = spark.readStream.schema("url string, title string, body string, fetched_at long, outlinks array<string>").option("maxFilesPerTrigger", files_each).option("pathGlobFilter", "*.parquet").option("cleanSource", retire)
    if retire == "archive":
        reader = reader.option("sourceArchiveDir", archive)
    stream = reader.parquet(spool)

    def take(df: DataFrame, batch: int) -> None:
        drain_batch(spark, df, writer, report, int((clock or time.time)()), totals, timeline, f"{checkpoint}#{batch}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    return report


def host_totals_after(batches: list[DataFrame]) -> DataFrame:
    """(host, inlinks) after batches of edges (src, dst) came in one by one, each of them twice, as after a failure."""
    spark = batches[0].sparkSession
    totals = HostTotals(spark, new_folder(spark, "totals"))
    for i, edges in enumerate(batches):
        for _ in range(2):
            totals.record(edges, f"batch {i}")
    return totals.read()
