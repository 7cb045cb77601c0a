"""State that outlives a run: drains, timelines, totals, streams; and what a service tells of it."""

import gzip
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from seekspark.errors import MissingIndex
from seekspark.functions import fetching, html, phrases, robots, urls
from seekspark.operators import analytics, engine, frontier, graph
from seekspark.operators.engine import SearchIndex
from seekspark.operators.service import Service
from seekspark.sources import files, tables
from seekspark.streaming import growth
from seekspark.streaming.deltas import Deltas
from seekspark.streaming.drain import HostTotals, Report, drain, drain_batch

DOC = "url string, title string, body string, fetched_at long, outlinks array<string>"


def spool(spark, folder, rows):
    spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(str(folder))


def test_drains_carry_host_totals_and_timeline_on(spark, tmp_path):
    page = lambda i, *links: (f"https://h{i}.example/{i}", f"T{i}", f"body {i}", 10 + i, list(links))
    spool(spark, tmp_path / "spool", [page(1, "https://b.example/"), page(2, "https://b.example/")])
    where = str(tmp_path / "index")
    one = drain(spark, str(tmp_path / "spool"), where, str(tmp_path / "c"), clock=lambda: 965)
    spool(spark, tmp_path / "spool", [page(3, "https://b.example/"), page(4, "https://h1.example/1")])
    two = drain(spark, str(tmp_path / "spool"), where, str(tmp_path / "c"), clock=lambda: 1025)
    assert (one.gained, two.gained, two.batches) == (2, 2, 1)
    totals = {r["host"]: r["inlinks"] for r in HostTotals(spark, f"{where}/graph").read().collect()}
    assert totals == {"b.example": 3, "h1.example": 1}
    state = tables.Timeline(spark, f"{where}/history.json").read()
    assert state["buckets"] == [{"at": 960, "documents": 2}, {"at": 1020, "documents": 2}] and state["total_documents"] == 4 and state["updated_at"] == 1025
    third = drain(spark, str(tmp_path / "spool"), where, str(tmp_path / "c"))
    assert third.batches == 0 and SearchIndex.open(spark, where).search("body").total_matches == 4


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    docs = spark.createDataFrame([("https://a.example/", "A", "x", 1, ["https://b.example/"])], DOC)
    writer = engine.IndexWriter(spark, str(tmp_path / "index"))
    totals, line = HostTotals(spark, str(tmp_path / "g")), tables.Timeline(spark, str(tmp_path / "h.json"))
    for by in ("c#0", "c#0", "c#1"):
        drain_batch(spark, docs, writer, Report(), 960, totals, line, by)
    assert [tuple(r) for r in totals.read().collect()] == [("b.example", 2)]
    assert line.read()["buckets"] == [{"at": 960, "documents": 1}] and writer.doc_count() == 1
    scored = writer.documents().first()
    assert scored["host_authority"] == 0 and scored["authority"] > 0


def test_timeline_keeps_the_last_buckets(spark, tmp_path):
    line = tables.Timeline(spark, str(tmp_path / "h.json"), retained=3)
    for minute, n in ((0, 1), (0, 2), (2, 4), (3, 5), (9, 6)):
        line.record(60 * minute + 7, n, 50)
    assert line.read()["buckets"] == [{"at": 120, "documents": 4}, {"at": 180, "documents": 5}, {"at": 540, "documents": 6}]
    (tmp_path / "h.json").write_text("{broken")
    assert line.record(61, 1, 1)["buckets"] == [{"at": 60, "documents": 1}] and line.buckets().count() == 1


def test_retire_after_commit(spark, tmp_path):
    """A drained segment is moved away once a later batch shows that its own was committed."""
    for i in range(3):
        spool(spark, tmp_path / "spool", [(f"https://a.example/{i}", "T", "words", i, [])])
        drain(spark, str(tmp_path / "spool"), str(tmp_path / "index"), str(tmp_path / "c"), retire="delete")
    assert engine.IndexWriter(spark, str(tmp_path / "index")).doc_count() == 3
    assert len(list((tmp_path / "spool").glob("*.parquet"))) < 3


def test_service(spark, tmp_path):
    now = [1000.0]
    service = Service(spark, str(tmp_path / "index"), str(tmp_path / "spool"), str(tmp_path / "crawl.json"), clock=lambda: now[0])
    assert service.health()["status"] == "degraded" and "MissingIndex" in service.health()["detail"] and service.growth()["available"] is False
    assert service.overview()["index"] is None and service.metrics()["process"]["max_rss_bytes"] > 0
    with pytest.raises(MissingIndex):
        service.search("words")
    spool(spark, tmp_path / "spool", [("https://a.example/", "T", "some words", 900, []), ("https://b.example/", "T", "words", 900, [])])
    drain(spark, str(tmp_path / "spool"), str(tmp_path / "index"), clock=lambda: 960)
    assert service.health() == {"status": "ok", "version": service.health()["version"], "index_open": True, "detail": None}
    assert service.search("words", now=1000.0).total_matches == 2
    counters = spark.createDataFrame([tuple(range(9))], "queued long, fetched long, indexed long, failed long, disallowed long, sitemaps long, skipped_offsite long, skipped_assets long, redirected_offsite long")
    tables.write_crawl_stats(counters, spark.createDataFrame([("u", "h"), ("v", "h")], "url string, host string"), str(tmp_path / "crawl.json"), 995)
    files.write_over(spark, str(tmp_path / "crawl.json"), json.dumps(service.crawl_stats.read() | {"unknown": 1}))
    (tmp_path / "spool" / "x.open").write_text("")
    seen = service.overview()
    assert seen["index"]["documents"] == 2 and seen["queries"]["total_recorded"] == 1 and seen["queries"]["recent"][0]["query"] == "words"
    assert seen["crawler"] == {"queued": 0, "fetched": 1, "indexed": 2, "failed": 3, "disallowed": 4, "sitemaps": 5, "skipped_offsite": 6, "skipped_assets": 7, "redirected_offsite": 8, "frontier_pending": 2, "hosts": 1, "updated_at": 995, "age_seconds": 5.0, "stale": False}
    assert (seen["spool"]["sealed_segments"], seen["spool"]["open_segments"]) == (1, 1) and seen["spool"]["sealed_bytes"] > 0
    grown = service.growth()
    assert grown["available"] and grown["total_documents"] == 2 and grown["last_hour"] == 2 and not grown["idle"] and grown["age_seconds"] == 40
    now[0] = 2000.0
    assert service.growth()["idle"] and service.growth()["projected_hour"] == 0 and service.overview()["crawler"]["stale"]
    service.reset()
    assert service.overview()["queries"]["total_recorded"] == 0


def test_deltas(spark, tmp_path):
    table = Deltas(spark, str(tmp_path / "t"), "k", every=4)
    assert table.read() is None
    rng, want = random.Random(3), {}
    for batch in range(11):
        rows = {rng.randrange(8): rng.randrange(100) for _ in range(3)}
        for _ in range(1 + (batch in (3, 7, 9))):
            table.write(spark.createDataFrame(list(rows.items()), "k long, v long"), batch)
        want |= rows
        assert {r["k"]: r["v"] for r in table.read().collect()} == want
    assert sum(n.startswith("batch") for n in files.names(spark, str(tmp_path / "t"))) <= 8


def test_seen_urls(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert tables.load_seen(spark, path).count() == 0
    tables.save_seen(spark.createDataFrame([("a",), ("b",), ("a",)], "url string"), path)
    assert tables.load_seen(spark, path).count() == 2
    for p in (tmp_path / "seen").glob("*.parquet"):
        p.write_bytes(b"not parquet")
    assert tables.load_seen(spark, path).count() == 0


def test_folder_size(spark, tmp_path):
    now = [0.0]
    size = tables.FolderSize(spark, str(tmp_path / "f"), 5.0, clock=lambda: now[0])
    assert size.bytes() == 0
    (tmp_path / "f" / "g").mkdir(parents=True)
    (tmp_path / "f" / "g" / "x").write_bytes(b"12345")
    assert size.bytes() == 5
    (tmp_path / "f" / "y").write_bytes(b"123")
    assert size.bytes() == 5
    now[0] = 5.0
    assert size.bytes() == 8 == tables.folder_bytes(spark, str(tmp_path / "f"))


def test_one_writer_wins(spark, tmp_path):
    path = str(tmp_path / "v.json")
    assert files.write_new(spark, path, "1") and not files.write_new(spark, path, "2") and files.read_text(spark, path) == "1"
    files.write_over(spark, path, "3")
    assert files.read_text(spark, path) == "3" and files.names(spark, str(tmp_path)) == [n for n in files.names(spark, str(tmp_path)) if "tmp" not in n]
    assert files.read_text(spark, path + "x") is None


def test_streams_of_urls_and_progress(spark, tmp_path):
    rows = [(i % 7, float(i)) for i in range(60)]
    spark.createDataFrame(rows, "user_id long, value double").repartition(4).write.parquet(str(tmp_path / "in"))
    listener = growth.ProgressFile(spark, str(tmp_path / "progress.json"), every_s=0.0)
    spark.streams.addListener(listener)
    try:
        assert sorted(r["user_id"] for r in growth.seen_once(spark, str(tmp_path / "in"), "user_id").collect()) == list(range(7))
        until = time.time() + 20
        while time.time() < until and not any(q.get("ended") for q in (listener.file.read() or {"queries": {}})["queries"].values()):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    told = listener.file.read()
    assert any(q.get("ended") and q["rows"] == 60 for q in told["queries"].values())
    age = spark.range(1).select(analytics.crawl_age(F.lit(float(told["updated_at"])), told["updated_at"] + 11.0).alias("a")).first()["a"]
    assert age["stale"] and age["age_s"] == 11.0


def test_politeness_with_timers(spark, tmp_path):
    """Of each host one job at once, the others when its delay is over."""
    jobs = [("a", 1, 1500), ("a", 2, 1500), ("b", 3, 1500), ("a", 4, 1500)]
    spark.createDataFrame(jobs, "host string, seq long, delay_ms long").coalesce(1).write.parquet(str(tmp_path / "jobs"))
    stream = spark.readStream.schema("host string, seq long, delay_ms long").parquet(str(tmp_path / "jobs"))
    got = []
    query = growth.politely(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start()
    try:
        until = time.time() + 60
        while len(got) < 4 and time.time() < until:
            time.sleep(0.3)
    finally:
        query.stop()
    assert [s for h, s, _ in got if h == "a"] == [1, 2, 4] and [s for h, s, _ in got if h == "b"] == [3]
    at = [t for h, _, t in got if h == "a"]
    assert all(b - a >= 1500 for a, b in zip(at, at[1:]))


def test_crawl_within_a_budget(spark):
    pages = spark.createDataFrame([(f"https://h.example/{i}", [f"https://h.example/{2 * i + 1}", f"https://h.example/{2 * i + 2}"]) for i in range(40)], "url string, links array<string>")
    seeds = spark.createDataFrame([("https://h.example/0",)], "url string")
    out = frontier.crawl(pages, seeds, max_depth=4, budget=10).collect()
    assert len(out) == 10 and max(r["depth"] for r in out) <= 3 and frontier.crawl(pages, seeds, max_depth=4).count() == 31


def test_redirects_are_dropped_on_demand(spark):
    scope = spark.createDataFrame([("a.example",)], "host string")
    visits = spark.createDataFrame([("https://a.example/1", "https://a.example/2#x"), ("https://a.example/3", "https://b.example/"), ("https://a.example/4", None)], "url string, final_url string")
    assert {r["final_url"]: r["redirected_offsite"] for r in frontier.after_redirects(visits, scope).collect()} == {"https://a.example/2": False, "https://b.example/": True, "https://a.example/4": False}
    assert frontier.after_redirects(visits, scope, drop=True).count() == 2 and frontier.after_redirects(visits, None, drop=True).count() == 3


def test_robots_rules_keep_repeated_rows(spark):
    paths = spark.createDataFrame([("a", "/x/1", None)] * 3 + [("b", "/x", True), (None, "/x", True)], "host string, path string, allowed boolean")
    rules = spark.createDataFrame([("a", "/x", False), ("a", "/x/1", True), ("c", "/", False)], "host string, pattern string, is_allow boolean")
    assert [r["allowed"] for r in robots.allowed(paths, rules).collect()] == [True] * 5
    assert robots.allowed(paths, rules.filter("NOT is_allow")).filter("NOT allowed").count() == 3


def test_scores_by_url(spark):
    docs = spark.createDataFrame([("u", 9.0), ("v", 9.0)], "url string, authority double")
    scores = spark.createDataFrame([("u", 0.5, 0.25)], "url string, authority double, host_authority double")
    assert {r["url"]: (r["authority"], r["host_authority"]) for r in graph.with_scores(docs, scores).collect()} == {"u": (0.5, 0.25), "v": (0.0, 0.0)}


def test_bodies_that_are_broken():
    whole = gzip.compress("é text".encode() * 50)
    assert fetching.decode(whole, None) == "é text" * 50
    assert fetching.decode(whole[:25], "utf-8") == whole[:25].decode("utf-8", "replace") and fetching.decode(b"\x1f\x8bnot gzip", None) == b"\x1f\x8bnot gzip".decode("utf-8", "replace")
    assert fetching.decode(b"\x93quoted\x94 \x80 \x81", "ISO-8859-1") == "“quoted” € \x81" and fetching.decode(b"\xe9", "no-such") == "�"
    assert fetching.decode(gzip.compress(b"\x93"), "latin1") == "“" and len(fetching.decode(gzip.compress(b"a" * 100), None, 10)) == 10


def test_record_ids(spark):
    """Golden values: two XXH3 digests of URL and time in either order."""
    row = spark.createDataFrame([("https://a.example/", 1_700_000_000)], "u string, t long").select(fetching.record_id("u", "t").alias("r"), fetching.jitter_ms("u", F.lit(1), F.lit(5)).alias("j")).first()
    import xxhash

    a, b = xxhash.xxh3_64_hexdigest(b"https://a.example/\x011700000000"), xxhash.xxh3_64_hexdigest(b"1700000000\x01https://a.example/")
    assert row["r"].replace("-", "") == f"urn:uuid:{a}{b}" and 0 <= row["j"] < 250 == 250


def test_xml_locations_of_odd_bodies():
    assert html.locations(b"<a xmlns='x'><loc> u </loc><loc/><LOC>v</LOC><!-- c --></a>") == ["u"]
    assert html.locations(gzip.compress(b"<a><loc>u</loc></a>")) == ["u"]
    for bad in (None, b"", b"<a><loc>u</loc>", gzip.compress(b"<a><loc>u</loc></a>")[:20], b"text"):
        assert html.locations(bad) == []


def test_phrases(spark):
    row = lambda **c: spark.range(1).select(*(v.alias(k) for k, v in c.items())).first().asDict()
    lit = F.lit
    assert row(a=phrases.format_date(lit(0)), b=phrases.format_date(lit("x")), c=phrases.format_clock(lit(-60)), d=phrases.format_age(lit(None)), e=phrases.format_age(lit(4.9)), f=phrases.format_age(lit(59)), g=phrases.format_age(lit(3599)), h=phrases.format_age(lit(5400)), i=phrases.format_count(lit(1234567)), j=phrases.format_count(lit("x"))) == {
        "a": "01 Jan 1970, 00:00 UTC", "b": "unknown", "c": "23:59", "d": "never", "e": "just now", "f": "59 s ago", "g": "59 min ago", "h": "1.5 h ago", "i": "1 234 567", "j": "0",
    }
    state = lambda *a: phrases.growth_state(*map(lit, a))
    assert row(a=state(False, False, 1.0, 1.0), b=state(True, True, 1.0, 1.0), c=state(True, False, 1500.0, 61.0), d=state(True, False, 0.0, 1.0), e=state(True, False, 2500.0, None)) == {"a": "no index reading yet", "b": "indexer idle", "c": "quiet 1 min · 1 500/min avg", "d": "indexer running", "e": "indexing 2 500/min"}
    assert [phrases.positive_int(x, 7) for x in (None, "3", "0", "x", "-2")] == [7, 3, 7, 7, 7]
    assert row(a=urls.breadcrumb(lit("https://www.a.example/b%20c/d/e/f?x"))) == {"a": "a.example › b c › d › e"}


def test_monotone_curve(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(50):
        x, y = np.cumsum(rng.random(12) + 0.1), rng.integers(0, 5, 12).astype(float)
        m = phrases.tangents(x, y)
        for i in range(11):
            t = np.linspace(0, 1, 60)
            h = x[i + 1] - x[i]
            curve = (2 * t**3 - 3 * t**2 + 1) * y[i] + (t**3 - 2 * t**2 + t) * h * m[i] + (3 * t**2 - 2 * t**3) * y[i + 1] + (t**3 - t**2) * h * m[i + 1]
            assert min(y[i], y[i + 1]) - 1e-9 <= curve.min() and curve.max() <= max(y[i], y[i + 1]) + 1e-9
    assert phrases.smooth_path([], []) == "" and phrases.smooth_path([1], [2]) == "M 1.000 2.000" and phrases.smooth_path([0, 3], [0, 3]).startswith("M 0.000 0.000 C 1.000 1.000 2.000 2.000 3.000 3.000")
    points = spark.createDataFrame([("a", 2.0, 1.0), ("a", 1.0, 0.0), ("b", 5.0, 5.0)], "s string, x double, y double")
    assert sorted(tuple(r) for r in phrases.with_tangents(points, by="s").collect()) == [("a", 1.0, 0.0, 1.0), ("a", 2.0, 1.0, 1.0), ("b", 5.0, 5.0, 0.0)]
