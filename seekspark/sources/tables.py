"""Tables in, tables out: Parquet, text and JSON state files, spool segments."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.errors import SpoolError
from seekspark.sources import files

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets one of this machine, removed at exit, and a cluster an error: its executors couldn't read such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="seekspark-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return _OWN[app]


def durable(df: DataFrame) -> DataFrame:
    """A copy that survives lost executors, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_seeds(spark: SparkSession, path: str, given: list[str] = ()) -> DataFrame:
    """Seed URLs: those given, then the file's lines without blanks and ``#`` comments; repeated ones stay. None at all is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"), F.monotonically_increasing_id().alias("seq")).filter("url <> '' AND NOT url LIKE '#%'")
    first = spark.createDataFrame([(u, i - len(given)) for i, u in enumerate(given)], "url string, seq long")
    out = first.unionByName(lines)
    if out.isEmpty():
        raise ValueError("no seeds")
    return out


def write_seeds(df: DataFrame, path: str, notes: tuple[str, ...] = ()) -> None:
    """One URL a line in the order of ``place``, behind comment lines."""
    head = df.sparkSession.createDataFrame([(f"# {n}", i - len(notes)) for i, n in enumerate(notes)], "value string, place long")
    head.unionByName(df.select(F.col("url").alias("value"), F.col("place").cast("long"))).repartitionByRange(1, "place").sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)


def read_spool(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Documents of the sealed segments of a folder, with the sequence number in each segment's name; a corrupt segment is an error, a missing folder is empty."""
    if not files.exists(spark, folder):
        if schema is None:
            raise SpoolError(f"no folder {folder} and no schema to read it as empty")
        return spark.createDataFrame([], schema + ", segment long")
    reader = spark.read.option("ignoreCorruptFiles", "false").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    df = reader.schema(schema).parquet(folder) if schema else reader.parquet(folder)
    number = F.regexp_extract(F.input_file_name(), r"(\d+)[^/]*\.parquet$", 1).try_cast("long")
    return df.withColumn("segment", F.coalesce(number, F.lit(2**63 - 1)))


def write_spool(df: DataFrame, folder: str, rows: int = 50_000) -> None:
    """Seal a batch as segments of bounded size: the commit of a Parquet write is the seal."""
    df.write.mode("append").option("maxRecordsPerFile", rows).parquet(folder)


def next_sequence(names: DataFrame, column: str = "name") -> DataFrame:
    """One row: the number behind the highest in the names."""
    return names.agg((F.coalesce(F.max(F.regexp_extract(column, r"(\d+)", 1).try_cast("long")), F.lit(-1)) + 1).alias("next"))


def known_fields(json_text: Column, schema: str) -> Column:
    """The fields of a JSON record that ``schema`` names; others are ignored, missing and broken ones are NULL."""
    return F.from_json(json_text, schema, {"mode": "PERMISSIVE"})


class StateFile:
    """A JSON state file whose content is read again only when the file's time or size has changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.reads = spark, str(path), 0
        self._seen: tuple | None = None
        self._state: dict | None = None

    def read(self) -> dict | None:
        """None if it is missing or isn't whole."""
        now = files.stamp(self.spark, self.path)
        if now is None:
            self._seen, self._state = None, None
        elif now != self._seen:
            self.reads += 1
            self._seen, self._state = now, files.read_json(self.spark, self.path)
        return self._state

    def write(self, state: dict) -> None:
        """Whole or not at all."""
        files.write_over(self.spark, self.path, json.dumps(state))


CRAWL_FIELDS = "queued fetched indexed failed disallowed sitemaps skipped_offsite skipped_assets redirected_offsite frontier_pending hosts updated_at".split()


def write_crawl_stats(counters: DataFrame, frontier: DataFrame, path: str, now: float | None = None) -> dict:
    """Publish a crawl's progress: the nine counters (one row), jobs that wait, their hosts, and when."""
    spark = counters.sparkSession
    pending = frontier.agg(F.count("*").alias("frontier_pending"), F.count_distinct("host").alias("hosts")).first()
    state = counters.first().asDict() | pending.asDict() | {"updated_at": int(time.time() if now is None else now)}
    state = {k: int(state[k]) for k in CRAWL_FIELDS}
    StateFile(spark, path).write(state)
    return state


def spool_backlog(spark: SparkSession, folder: str, sealed: str = ".parquet", opened: str = ".open") -> dict:
    """Sealed segments, which the indexer owes work on, their bytes, and segments still being written; nothing for a missing folder."""
    found = files.listing(spark, folder)
    done = [size for name, size, plain in found if plain and name.endswith(sealed)]
    return {"sealed_segments": len(done), "sealed_bytes": sum(done), "open_segments": sum(plain and name.endswith(opened) for name, _, plain in found), "path": str(folder)}


class FolderSize:
    """Bytes below a folder, measured again after ``ttl_s`` seconds; an empty or missing folder each time."""

    def __init__(self, spark: SparkSession, folder: str, ttl_s: float = 5.0, clock=time.monotonic):
        self.spark, self.folder, self.ttl_s, self.clock = spark, str(folder), ttl_s, clock
        self._at, self._bytes = 0.0, 0

    def bytes(self) -> int:
        now = self.clock()
        if not self._bytes or now - self._at >= self.ttl_s:
            self._at, self._bytes = now, files.size_below(self.spark, self.folder)
        return self._bytes


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder."""
    return files.size_below(spark, folder)


def save_seen(urls: DataFrame, path: str) -> None:
    """Keep the set of URLs that were seen, exactly and each once."""
    urls.select("url").distinct().write.mode("overwrite").parquet(path)


def load_seen(spark: SparkSession, path: str) -> DataFrame:
    """The set kept at ``path``; empty if there is none, or none that can be read."""
    try:
        if files.exists(spark, path):
            df = spark.read.schema("url string").parquet(path)
            df.limit(1).count()
            return df
    except (PySparkException, Py4JJavaError):
        pass
    return spark.createDataFrame([], "url string")


GROWTH = T.StructType([T.StructField("at", T.LongType()), T.StructField("documents", T.LongType())])


class Timeline:
    """Documents gained by minute, kept in a file: the last ``retained`` buckets."""

    def __init__(self, spark: SparkSession, path: str, retained: int = 180, bucket_s: int = 60):
        self.file, self.spark, self.retained, self.bucket_s = StateFile(spark, path), spark, retained, bucket_s

    def record(self, now: int, documents: int, total: int, by: str | None = None) -> dict:
        """Add to the last bucket if it is the same minute, else behind it. ``by`` names what is recorded: the same name again changes nothing."""
        state = self.file.read() or {"updated_at": None, "total_documents": 0, "buckets": [], "by": None}
        if by is not None and state.get("by") == by:
            return state
        buckets, at = list(state["buckets"]), int(now) - int(now) % self.bucket_s
        if buckets and buckets[-1]["at"] == at:
            buckets[-1] = {"at": at, "documents": buckets[-1]["documents"] + documents}
        else:
            buckets.append({"at": at, "documents": documents})
        state = {"updated_at": int(now), "total_documents": total, "buckets": buckets[-self.retained :], "by": by}
        self.file.write(state)
        return state

    def read(self) -> dict | None:
        return self.file.read()

    def buckets(self) -> DataFrame:
        state = self.file.read() or {"buckets": []}
        return self.spark.createDataFrame([(b["at"], b["documents"]) for b in state["buckets"]], GROWTH)
