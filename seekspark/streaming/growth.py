"""Growth by minute, and figures by key, of a stream of events."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from seekspark.sources.tables import StateFile
from seekspark.streaming.deltas import Deltas
from seekspark.streaming.folders import new_folder, stream_of


def windows(events: DataFrame, ts: str = "ts", width: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """(at, documents) of tumbling windows over event time; what comes later than the watermark is left out."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("documents")).select(F.unix_timestamp("w.start").alias("at"), "documents")


def run_to_end(stream: DataFrame, mode: str, into) -> None:
    """All there is now, batch by batch, through ``into(df, batch_id)``."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", new_folder(stream.sparkSession, "stream")).trigger(availableNow=True).foreachBatch(into).start()
    query.awaitTermination()


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """The minute windows after the last batch of a stream over a table; a batch writes the windows that it changed."""
    table = Deltas(spark, new_folder(spark, "growth"), "at")
    run_to_end(windows(stream_of(spark, path), late="36500 days"), "update", table.write)
    return table.read().select("at", "documents")


def keep_figures(keys, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Number and maximum of a key's values, carried over from batch to batch."""
    n, highest = state.get if state.exists else (0, float("-inf"))
    for batch in batches:
        n += len(batch)
        highest = max(highest, batch["value"].max()) if len(batch) else highest
    state.update((n, highest))
    yield pd.DataFrame({"user_id": [keys[0]], "events": [n], "highest": [highest]})


def per_key(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, events, highest) after the last batch."""
    table = Deltas(spark, new_folder(spark, "state"), "user_id")
    stream = stream_of(spark, path).select("user_id", "value").groupBy("user_id").applyInPandasWithState(keep_figures, "user_id long, events long, highest double", "n long, highest double", "update", GroupStateTimeout.NoTimeout)
    run_to_end(stream, "update", lambda df, batch: table.write(df.select("user_id", "events", "highest"), batch))
    return table.read().select("user_id", "events", "highest")


def ready_hosts(keys, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Politeness by host: of its jobs the oldest goes at once if the host's time has come, the others wait in the state for its timer. The host's longest delay holds."""
    waiting, next_ms, delay = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0, 1000)
    for batch in batches:
        if len(batch):
            waiting += batch.sort_values("seq")["seq"].tolist()
            delay = max(delay, int(batch["delay_ms"].max()))
    now = state.getCurrentProcessingTimeMs()
    out = []
    if waiting and now >= next_ms:
        out, waiting, next_ms = [waiting[0]], waiting[1:], now + delay
    state.update((waiting, next_ms, delay))
    if waiting:
        state.setTimeoutDuration(max(1, next_ms - now))
    yield pd.DataFrame({"host": [keys[0]] * len(out), "seq": out, "at_ms": [now] * len(out)})


def politely(jobs: DataFrame) -> DataFrame:
    """(host, seq, at_ms): the stream of jobs (host, seq, delay_ms) that may run, one for each host and delay."""
    return jobs.groupBy("host").applyInPandasWithState(ready_hosts, "host string, seq long, at_ms long", "waiting array<long>, next_ms long, delay_ms long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def first_seen(urls: DataFrame, column: str = "url") -> DataFrame:
    """Of a stream, each URL once, when it first comes: the set of those seen is the stream's state, exact and kept with its checkpoint."""
    return urls.dropDuplicates([column])


def seen_once(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The values of a column that a stream over a table let through."""
    out = new_folder(spark, "seen")
    run_to_end(first_seen(stream_of(spark, path).select(column), column), "append", lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/{batch}"))
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


class ProgressFile(StreamingQueryListener):
    """Publishes how far the session's streams are: batch, rows and time of each query's last progress, in one state file."""

    def __init__(self, spark: SparkSession, path: str, every_s: float = 2.0, clock=time.time):
        self.file, self.every_s, self.clock, self.state, self._at = StateFile(spark, path), every_s, clock, {}, float("-inf")

    def onQueryStarted(self, event) -> None:
        self._tell(str(event.id), {"batch": None, "rows": 0}, True)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = self.state.get(str(p.id), {}).get("rows", 0) + int(p.numInputRows or 0)
        self._tell(str(p.id), {"batch": p.batchId, "rows": rows}, False)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._tell(str(event.id), self.state.get(str(event.id), {}) | {"ended": True}, True)

    def _tell(self, query: str, what: dict, at_once: bool) -> None:
        now = self.clock()
        self.state[query] = what | {"updated_at": int(now)}
        if at_once or now - self._at >= self.every_s:
            self._at = now
            self.file.write({"queries": self.state, "updated_at": int(now)})
