"""The index on disk, and the search service over it."""

from __future__ import annotations

import json
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.config import SearchConfig
from seekspark.errors import EngineError, IncompatibleSchema, LimitError, MissingIndex
from seekspark.functions import urls
from seekspark.functions.text import snippet
from seekspark.operators import ranking, search
from seekspark.plans.query_parser import FIELDS, RAW, all_leaves, parse
from seekspark.sources import files

DOCS = T.StructType(
    [
        T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("body", T.StringType()),
        T.StructField("fetched_at", T.LongType()), T.StructField("authority", T.DoubleType()), T.StructField("host_authority", T.DoubleType()),
    ]
)
#: Rows in one bucket of a segment's documents, by a hash of the URL, and documents to one bucket of its postings, by a hash of the term: queries read few of them.
BUCKET_ROWS = 100_000
#: Documents to one part of a bucket of postings, so that no task holds all of a frequent term.
PART_ROWS = 200_000
MOST_BUCKETS = 4096
#: Segments of one level that are merged into one of the next.
FANOUT = 8
#: Replaced documents that are sent to all tasks; more are joined by a shuffle.
SENT_ROWS = 200_000
INDEXED = (*FIELDS, *RAW)


def check_schema(df: DataFrame) -> None:
    own = [(f.name, f.dataType) for f in df.schema]
    if own != [(f.name, f.dataType) for f in DOCS]:
        raise IncompatibleSchema(f"{df.schema.simpleString()} instead of {DOCS.simpleString()}")


def as_documents(df: DataFrame) -> DataFrame:
    """The six indexed columns; a missing score is 0."""
    have = set(df.columns)
    return df.select("url", "title", "body", F.col("fetched_at").cast("long").alias("fetched_at"), *(F.coalesce(F.col(c).cast("double") if c in have else F.lit(None), F.lit(0.0)).alias(c) for c in ("authority", "host_authority")))


def latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Of each key the row with the greatest ``seq``; whole rows travel once, and a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, *(F.col(f"r.`{c}`").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def read_meta(spark: SparkSession, path: str) -> dict | None:
    """What the newest version consists of; None without a commit. A version's file is written once and whole, and never changed."""
    for name in reversed(files.names(spark, f"{path}/versions")):
        if name.endswith(".json") and (meta := files.read_json(spark, f"{path}/versions/{name}")) is not None:
            return meta
    return None


def _live(rows: DataFrame, dead: DataFrame | None, n_dead: int, key: str) -> DataFrame:
    """``rows`` (segment, key ...) but those that a later commit replaced."""
    if dead is None:
        return rows
    gone = dead.select("segment", F.col("url").alias(key))
    return rows.join(F.broadcast(gone) if n_dead <= SENT_ROWS else gone, ["segment", key], "left_anti")  # counted when it was written


def read_tables(spark: SparkSession, path: str, meta: dict, urls_wanted: list[str] | None = None, terms_wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, postings) of a version. Given URLs or terms, only the buckets that can hold them are read."""
    docs = posted = None

    def buckets(column: str, wanted: list[str], n: int) -> list[int]:
        rows = spark.createDataFrame([(x,) for x in wanted], f"`{column}` string").select(_bucket(column, n).alias("b")).distinct().collect()
        return [r["b"] for r in rows]

    asked: dict[tuple, list[int]] = {}
    for s in meta["segments"]:
        a = spark.read.schema(_STORED).parquet(f"{path}/segments/{s['name']}/docs")
        b = spark.read.schema(_POSTED).parquet(f"{path}/segments/{s['name']}/postings")
        if urls_wanted is not None:
            key = "url", s["doc_buckets"]
            asked[key] = asked[key] if key in asked else buckets("url", urls_wanted, s["doc_buckets"])
            a = a.filter(F.col("bucket").isin(*asked[key]) & F.col("url").isin(*urls_wanted))
        if terms_wanted is not None:
            key = "term", s["term_buckets"]
            asked[key] = asked[key] if key in asked else buckets("term", terms_wanted, s["term_buckets"])
            b = b.filter(F.col("bucket").isin(*asked[key]) & F.col("term").isin(*terms_wanted))
        a, b = (x.drop("bucket").withColumn("segment", F.lit(s["name"])) for x in (a, b))
        docs, posted = a if docs is None else docs.unionByName(a), b if posted is None else posted.unionByName(b)
    dead = None
    if meta["dead"]:
        dead = spark.read.schema(_DEAD).parquet(*(f"{path}/dead/{d['name']}" for d in meta["dead"]))
    n_dead = sum(d["rows"] for d in meta["dead"])
    return _live(docs, dead, n_dead, "url"), _live(posted, dead, n_dead, "id").drop("segment")


_LENGTHS = ", ".join(f"dl_{f} int" for f in INDEXED)
_STORED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DOCS) + f", {_LENGTHS}, bucket int"
_POSTED = "id string, field string, term string, tf int, positions array<int>, dl int, bucket int"
_DEAD = f"segment string, url string, {_LENGTHS}"


class IndexWriter:
    """Upserts documents by URL; nothing shows before a commit, a commit shows at once.

    A commit writes a segment of the new documents alone, with their postings, and the list of older rows that they replace; then
    a file that names the version's segments. ``FANOUT`` segments of one level are merged into one of the next, so a document is
    rewritten as often as there are levels: the logarithm of the index's size.
    """

    def __init__(self, spark: SparkSession, path: str, commit_docs: int = 1000, commit_s: float = 30.0):
        self.spark, self.path, self.commit_docs, self.commit_s = spark, str(path).rstrip("/"), commit_docs, commit_s
        files.make_folder(spark, f"{self.path}/versions")
        self._waiting: DataFrame | None = None
        self.pending, self._since, self._seq = 0, time.monotonic(), 0

    def meta(self) -> dict:
        return read_meta(self.spark, self.path) or {"version": 0, "documents": 0, "tokens": {f: 0 for f in INDEXED}, "segments": [], "dead": []}

    def version(self) -> int:
        return self.meta()["version"]

    def documents(self) -> DataFrame:
        meta = self.meta()
        return read_tables(self.spark, self.path, meta)[0].select(*DOCS.names) if meta["segments"] else self.spark.createDataFrame([], DOCS)

    def doc_count(self) -> int:
        return self.meta()["documents"]

    def add_or_update(self, docs: DataFrame) -> None:
        """The last of several rows with a URL counts; inside one table, by ``seq`` if it has that column, else by ``fetched_at``."""
        order = F.col("seq") if "seq" in docs.columns else F.col("fetched_at")
        batch = as_documents(latest(docs.withColumn("__order", order), "url", "__order")).withColumn("__batch", F.lit(self._seq))
        self._seq += 1
        self.pending += docs.count()
        self._waiting = batch if self._waiting is None else self._waiting.unionByName(batch)

    def should_commit(self) -> bool:
        return self.pending >= self.commit_docs or (self.pending > 0 and time.monotonic() - self._since >= self.commit_s)

    def _write_segment(self, docs: DataFrame, name: str, level: int, n: int) -> dict:
        """Documents and postings of ``n`` rows, in buckets by their number; the segment's entry."""
        folder = f"{self.path}/segments/{name}"
        doc_buckets = min(MOST_BUCKETS, -(-n // BUCKET_ROWS) or 1)
        term_buckets, parts = min(MOST_BUCKETS, -(-n // BUCKET_ROWS) * 4 or 1), -(-n // PART_ROWS) or 1
        sized = docs.select(*DOCS.names, *(F.size(search.terms_of(f)).alias(f"dl_{f}") for f in INDEXED), _bucket("url", doc_buckets).alias("bucket"))
        sized.repartition(doc_buckets, "bucket").sortWithinPartitions("bucket", "url").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/docs")
        stored = self.spark.read.schema(_STORED).parquet(f"{folder}/docs")
        posted = search.postings(stored, "url", INDEXED, unique=True).withColumn("bucket", _bucket("term", term_buckets))
        part = F.pmod(F.xxhash64("id"), F.lit(parts))
        posted.repartition(min(term_buckets * parts, MOST_BUCKETS), F.col("bucket"), part).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        sums = stored.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"dl_{f}"), F.lit(0)).alias(f) for f in INDEXED)).first()
        return {"name": name, "level": level, "docs": sums["n"], "tokens": {f: sums[f] for f in INDEXED}, "doc_buckets": doc_buckets, "term_buckets": term_buckets}

    def _replaced(self, meta: dict, fresh: DataFrame) -> DataFrame:
        """(segment, url, lengths) of the live rows whose URLs are in ``fresh``; of older segments only the buckets with such a URL are read."""
        out = None
        for s in meta["segments"]:
            rows = self.spark.read.schema(_STORED).parquet(f"{self.path}/segments/{s['name']}/docs")
            if s["doc_buckets"] > 1:
                touched = [r["b"] for r in fresh.select(_bucket("url", s["doc_buckets"]).alias("b")).distinct().collect()]
                rows = rows.filter(F.col("bucket").isin(*touched))
            rows = rows.select(F.lit(s["name"]).alias("segment"), "url", *(f"dl_{f}" for f in INDEXED))
            out = rows if out is None else out.unionByName(rows)
        dead = self.spark.read.schema(_DEAD).parquet(*(f"{self.path}/dead/{d['name']}" for d in meta["dead"])) if meta["dead"] else None
        return _live(out.join(fresh.select("url"), "url", "left_semi"), dead, sum(d["rows"] for d in meta["dead"]), "url").select("segment", "url", *(f"dl_{f}" for f in INDEXED))

    def commit(self) -> int:
        """Write what is waiting as a new version; the number of documents gained."""
        if self._waiting is None:
            return 0
        newest = latest(self._waiting.withColumn("__order", F.struct("__batch", "fetched_at")), "url", "__order").drop("__batch", "__order")
        meta = self.meta()
        version = meta["version"] + 1
        name = f"{version:08d}-{uuid.uuid4().hex[:8]}"
        segment = self._write_segment(newest, name, 0, self.pending)
        gone = {"n": 0} | {f: 0 for f in INDEXED}
        if meta["segments"] and segment["docs"]:
            fresh = self.spark.read.schema(_STORED).parquet(f"{self.path}/segments/{name}/docs").select("url")
            self._replaced(meta, fresh).write.mode("overwrite").parquet(f"{self.path}/dead/{name}")
            dead = self.spark.read.schema(_DEAD).parquet(f"{self.path}/dead/{name}")
            gone = dead.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"dl_{f}"), F.lit(0)).alias(f) for f in INDEXED)).first().asDict()
        new = {
            "version": version, "documents": meta["documents"] + segment["docs"] - gone["n"], "written_at": int(time.time()),
            "tokens": {f: meta["tokens"][f] + segment["tokens"][f] - gone[f] for f in INDEXED}, "segments": [*meta["segments"], *([segment] if segment["docs"] else [])],
            "dead": [*meta["dead"], *([{"name": name, "rows": gone["n"], "segments": [s["name"] for s in meta["segments"]]}] if gone["n"] else [])],
        }
        self._publish(new)
        gained = new["documents"] - meta["documents"]
        self._waiting, self.pending, self._since = None, 0, time.monotonic()
        while self.merge():
            pass
        return gained

    def _publish(self, meta: dict) -> None:
        if not files.write_new(self.spark, f"{self.path}/versions/{meta['version']:012d}.json", json.dumps(meta)):
            raise EngineError(f"another writer made version {meta['version']}")

    def merge(self) -> bool:
        """Merge the segments of the lowest level that has ``FANOUT`` of them, as a version of its own; False if no level has."""
        meta = self.meta()
        levels: dict[int, list[dict]] = {}
        for s in meta["segments"]:
            levels.setdefault(s["level"], []).append(s)
        full = [level for level, found in sorted(levels.items()) if len(found) >= FANOUT]
        if not full:
            return False
        old = levels[full[0]]
        docs, _ = read_tables(self.spark, self.path, meta | {"segments": old})
        version = meta["version"] + 1
        name = f"{version:08d}-{uuid.uuid4().hex[:8]}"
        merged = self._write_segment(docs, name, full[0] + 1, sum(s["docs"] for s in old))
        left = [s for s in meta["segments"] if s not in old]
        names = {s["name"] for s in left}
        self._publish(meta | {"version": version, "segments": [merged, *left], "dead": [d for d in meta["dead"] if names & set(d["segments"])], "written_at": int(time.time())})
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Remove versions but the last ``keep``, and segments and lists that none of those names; the number of folders removed."""
        found = files.names(self.spark, f"{self.path}/versions")
        for name in found[:-keep]:
            files.remove(self.spark, f"{self.path}/versions/{name}")
        metas = [m for n in found[-keep:] if (m := files.read_json(self.spark, f"{self.path}/versions/{n}"))]
        used = {x["name"] for m in metas for x in (*m["segments"], *m["dead"])}
        gone = [f"{self.path}/{kind}/{n}" for kind in ("segments", "dead") for n in files.names(self.spark, f"{self.path}/{kind}") if n not in used]
        for folder in gone:
            files.remove(self.spark, folder)
        return len(gone)


HITS = "engine_rank long, url string, title string, snippet string, fetched_at long, score double, authority double, host_authority double"
POOL = HITS + ", place long, host string"


@dataclass(frozen=True)
class Outcome:
    """A window of hits, at most some hundred rows of ``HITS``, and counts over all matches."""

    spark: SparkSession
    rows: list[tuple]
    total_matches: int
    doc_count: int
    elapsed_ms: float
    cached: bool
    relaxed: bool

    @property
    def hits(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, HITS)


@dataclass(frozen=True)
class Response:
    query: str
    hits: DataFrame
    returned: int
    total_matches: int
    doc_count: int
    took_ms: float
    cached: bool
    relaxed: bool
    limit: int
    offset: int
    reachable: int | None = None
    pages: int | None = None
    suppressed: int | None = None
    capped_on_page: int | None = None


class SearchIndex:
    """One committed version at a time; a later commit is seen by the next search."""

    def __init__(self, spark: SparkSession, path: str | None, tables=None, config: SearchConfig = SearchConfig(), count: int | None = None):
        self.spark, self.path, self.config, self._tables, self._count = spark, path, config, tables, count
        self._cache: OrderedDict = OrderedDict()
        self._warm: tuple[int, tuple] | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: SearchConfig = SearchConfig()) -> SearchIndex:
        path = str(path).rstrip("/")
        meta = read_meta(spark, path)
        if meta is None:
            raise MissingIndex(path)
        for s in meta["segments"]:
            check_schema(spark.read.parquet(f"{path}/segments/{s['name']}/docs").select(*DOCS.names))
        return cls(spark, path, config=config)

    @classmethod
    def over(cls, docs: DataFrame, config: SearchConfig = SearchConfig()) -> SearchIndex:
        """An index that lives as long as the session."""
        docs = as_documents(docs).cache()
        fields = search.field_stats(search.doc_lengths(docs, "url", INDEXED)).cache()
        return cls(docs.sparkSession, None, (docs, None, fields), config)

    def meta(self) -> dict:
        return read_meta(self.spark, self.path)

    def fingerprint(self) -> int:
        return self.meta()["version"] if self.path else 0

    def doc_count(self) -> int:
        """Documents of the current version: written down at its commit."""
        if self.path:
            return self.meta()["documents"]
        if self._count is None:
            self._count = self._tables[0].count()
        return self._count

    def _fields(self, meta: dict) -> DataFrame:
        n = max(meta["documents"], 1)
        return self.spark.createDataFrame([(f, meta["documents"], meta["tokens"][f] / n) for f in INDEXED], "field string, n long, avgdl double")

    def tables(self, terms: list[str] | None = None, asked: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(documents, postings, field statistics) of the current version; given terms, of the postings those of their buckets.

        Without a folder the postings are made for each query, those for which ``asked`` holds; all are kept only after :meth:`warm_up`.
        """
        if self._tables is not None:
            docs, posted, fields = self._tables
            return docs, search.postings(docs, "url", INDEXED, asked) if posted is None else posted, fields
        meta = self.meta()
        if self._warm is not None and self._warm[0] == meta["version"]:
            return self._warm[1]
        if not meta["segments"]:
            return self.spark.createDataFrame([], DOCS), search.postings(self.spark.createDataFrame([], DOCS), "url", INDEXED), self._fields(meta)
        docs, posted = read_tables(self.spark, self.path, meta, terms_wanted=terms)
        return docs.select(*DOCS.names), posted, self._fields(meta)

    def _stored(self, wanted: list[str]) -> DataFrame:
        """The documents of some URLs, from their buckets alone."""
        if self._tables is not None or not wanted:
            return self.tables()[0].filter(F.col("url").isin(*wanted))
        meta = self.meta()
        return read_tables(self.spark, self.path, meta, urls_wanted=wanted)[0].select(*DOCS.names) if meta["segments"] else self.tables()[0]

    def stats(self) -> dict:
        fields = self.tables()[2]
        return {"documents": self.doc_count(), "version": self.fingerprint(), "avg_tokens": {r["field"]: r["avgdl"] for r in fields.collect()}}

    def warm_up(self) -> int:
        """Hold the current version's postings in memory and on local disks, until a later commit; their number."""
        if self._tables is None:
            docs, posted, fields = self.tables()
            self._warm = self.fingerprint(), (docs, posted.persist(), fields)
        elif self._tables[1] is None:
            docs, posted, fields = self.tables()
            self._tables = docs, posted.persist(), fields
        return self.tables()[1].count()

    def search(self, query: str, limit: int = 10, offset: int = 0) -> Outcome:
        """Hits (engine_rank, url, title, snippet, fetched_at, score, authority, host_authority), best first, and counts over all matches.

        Documents are read for the hits alone, after the limit.
        """
        limit, began = max(limit, 1), time.monotonic()
        key = (query, limit, offset, self.fingerprint())
        if key in self._cache:
            self._cache.move_to_end(key)
            rows, total, count, relaxed = self._cache[key]
            return Outcome(self.spark, rows, total, count, (time.monotonic() - began) * 1e3, True, relaxed)
        asked = all_leaves(parse(query))
        wanted = sorted({t for leaf in asked for t in leaf.terms})
        # Without a range only the buckets of the query's own terms are read.
        _, posted, fields = self.tables(None if any(leaf.bounds for leaf in asked) else wanted, search.asked(asked))
        found = search.best(posted, fields, query, limit, offset) if asked else search.Best([], 0, False)
        place = {r["id"]: (i, r["score"]) for i, r in enumerate(found.rows, offset + 1)}
        told = self._stored(list(place)).select("url", "title", snippet(F.col("body"), {t: 1.0 for t in wanted}, self.config.snippet_chars).alias("snippet"), "fetched_at", "authority", "host_authority").collect() if place else []
        rows = sorted((place[r["url"]][0], r["url"], r["title"], r["snippet"], r["fetched_at"], place[r["url"]][1], r["authority"], r["host_authority"]) for r in told)
        count = self.doc_count()
        self._cache[key] = rows, found.total, count, found.relaxed
        while len(self._cache) > max(self.config.cache_entries, 1):
            self._cache.popitem(last=False)
        return Outcome(self.spark, rows, found.total, count, (time.monotonic() - began) * 1e3, False, found.relaxed)


@dataclass
class SearchEngine:
    """Search with re-ranking, wider windows where they are needed, and a log of queries."""

    index: SearchIndex
    config: SearchConfig = field(default_factory=SearchConfig)
    log: list[tuple] = field(default_factory=list)
    recorded: int = 0

    @classmethod
    def over(cls, docs: DataFrame, config: SearchConfig = SearchConfig()) -> SearchEngine:
        return cls(SearchIndex.over(docs, config), config)

    def candidates(self, limit: int, offset: int) -> int:
        c, needed = self.config, offset + limit
        return min(max(needed * c.candidate_factor, needed, c.least_candidates), c.most_candidates)

    def search(self, q: str, limit: int = 10, offset: int = 0, now: float | None = None) -> Response:
        c, now, began = self.config, time.time() if now is None else now, time.monotonic()
        if not 1 <= len(q) <= c.max_query_chars:
            raise ValueError(f"a query has 1 to {c.max_query_chars} characters")
        if not 1 <= limit <= c.max_limit or offset < 0:
            raise LimitError(f"limit {limit}, offset {offset}")
        try:
            response = self._ranked(q, limit, offset, now) if c.ranking_enabled else self._plain(q, limit, offset)
        except Exception:
            self._record(q, (time.monotonic() - began) * 1e3, 0, 0, False, True, now)
            raise
        self._record(q, response.took_ms, response.total_matches, response.returned, response.cached, False, now)
        return response

    def _plain(self, q, limit, offset) -> Response:
        found = self.index.search(q, limit, offset)
        return Response(q, found.hits.withColumnRenamed("engine_rank", "place"), len(found.rows), found.total_matches, found.doc_count, found.elapsed_ms, found.cached, found.relaxed, limit, offset)

    def _ranked(self, q, limit, offset, now) -> Response:
        c = self.config
        window = self.candidates(limit, offset)
        found = self.index.search(q, window)
        pool = self._pool(found, q, now)
        target = ranking.navigational_target(ranking.terms_of(q))
        if target and window < c.most_candidates and any(r["label"] == target for r in pool):
            window = c.most_candidates
            found = self.index.search(q, window)
            pool = self._pool(found, q, now)
        response = self._page(found, pool, q, limit, offset)
        if response.returned < limit and window < c.most_candidates and found.total_matches > window:
            wide = self.index.search(q, c.most_candidates)
            wider = self._page(wide, self._pool(wide, q, now), q, limit, offset)
            if wider.returned > response.returned:
                response = wider
        return response

    def _pool(self, found: Outcome, q, now) -> list:
        """The window's rows in their final order, with ``host`` and ``label``; duplicates collapsed."""
        if not found.rows:
            return []
        pool = ranking.ordered_pool(found.hits.coalesce(1), q, now, self.config.ranking)
        return pool.withColumn("host", urls.rank_host(F.col("url"))).withColumn("label", urls.host_label(F.col("url"))).orderBy("place").collect()

    def _page(self, found: Outcome, pool: list, q, limit, offset) -> Response:
        page = ranking.take_page(pool, limit, offset, self.config.ranking.max_per_domain)
        names = [x.split()[0] for x in POOL.split(", ")]
        hits = self.index.spark.createDataFrame([tuple(r[n] for n in names) for r in page.hits], POOL)
        return Response(q, hits, len(page.hits), found.total_matches, found.doc_count, found.elapsed_ms, found.cached, found.relaxed, limit, offset, len(pool), page.pages, len(found.rows) - len(pool), page.held_back)

    @staticmethod
    def page(response: Response) -> DataFrame:
        return response.hits.select("place", "url", "title", "snippet", F.round("score", 6).alias("score")).orderBy("place")

    def _record(self, q, took, total, returned, cached, failed, at) -> None:
        self.recorded += 1
        self.log.append((self.recorded, q, took, total, returned, cached, failed, float(at)))
        del self.log[:-512]

    def queries(self) -> DataFrame:
        """The retained query log."""
        return self.index.spark.createDataFrame(self.log, "seq long, query string, took_ms double, total_matches long, returned long, cached boolean, failed boolean, at double")

    def reset(self) -> None:
        self.log.clear()
        self.recorded = 0
