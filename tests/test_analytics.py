from seekspark.operators import analytics, frontier
from seekspark.sources import tables
from seekspark.sources.warc import WarcSink, read_warc


def log(spark, rows):
    return spark.createDataFrame(rows, "seq long, query string, took_ms double, total_matches long, returned long, cached boolean, failed boolean, at double")


def test_latency(spark):
    rows = [(i, "q", float(i), 1, 1, False, False, 0.0) for i in range(1, 101)] + [(101, "q", 1e6, 0, 0, False, True, 0.0)]
    r = analytics.latency(log(spark, rows)).first()
    assert (r["p50_ms"], r["p95_ms"], r["max_ms"], r["mean_ms"]) == (50.0, 95.0, 100.0, 50.5)
    thirty = log(spark, rows[:30])
    assert analytics.nearest_rank(thirty, "took_ms", {"p": 0.95}).first()["p"] == 28.0


def test_growth(spark):
    buckets = spark.createDataFrame([(100_000 - 20 * 60, 70), (100_000 - 180, 30), (100_000 - 6000, 999)], "at long, documents long")
    r = analytics.growth_figures(buckets, 100_000, 100_010).first()
    assert (r["last_hour"], r["last_quarter"], r["per_minute"], r["projected_hour"], r["idle"]) == (100, 30, 2.0, 120, False)
    gains = spark.createDataFrame([(960, 1), (1000, 2), (1020, 4), (-1, 8), (1021, -5)], "at long, gained long")
    assert {r["at"]: r["documents"] for r in analytics.growth_buckets(gains).collect()} == {960: 3, 1020: 4, -60: 8}


def test_series_is_the_naive_count(spark):
    rows = [(i, "q", float(i % 7), 1, 1, False, i % 3 == 0, 1000.0 - i * 3.7) for i in range(200)]
    got = {r["idx"]: r["count"] for r in analytics.series(log(spark, rows), 1000.0).collect()}
    want = [sum(700 + 10 * k <= r[-1] < 710 + 10 * k for r in rows) for k in range(30)]
    assert [got[k] for k in range(30)] == want


def test_empty_log(spark):
    r = analytics.snapshot(log(spark, []), 10.0, 512).first()
    assert r["retained"] == 0 and r["cache_hit_rate"] == 0 and r["matches"] == 0
    assert analytics.latency(log(spark, [])).first()["p50_ms"] is None


def test_bloom():
    bits, k, mib = frontier.bloom_size(100_000_000, 0.01)
    assert k == 7 and round(mib, 2) in (114.25, 114.26)


def test_state_and_seeds(spark, tmp_path):
    state = tables.StateFile(spark, str(tmp_path / "s.json"))
    assert state.read() is None
    state.write({"a": 1})
    assert state.read() == state.read() == {"a": 1} and state.reads == 1
    state.write({"a": 1, "b": 2})
    assert state.read() == {"a": 1, "b": 2} and state.reads == 2
    (tmp_path / "s.json").write_text('{"a": ')
    assert state.read() is None
    (tmp_path / "seeds.txt").write_text("# note\n\nhttps://a.example/\nhttps://a.example/\n")
    assert tables.read_seeds(spark, str(tmp_path / "seeds.txt"), ["https://b.example/"]).orderBy("seq").first()["url"] == "https://b.example/"
    listed = spark.createDataFrame([("u2", 2), ("u1", 1)], "url string, place long")
    tables.write_seeds(listed, str(tmp_path / "out"), ("two",))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["# two", "u1", "u2"]
    assert tables.folder_bytes(spark, str(tmp_path / "missing")) == 0


def test_spool(spark, tmp_path):
    df = spark.range(10).selectExpr("cast(id AS string) AS url")
    tables.write_spool(df, str(tmp_path / "spool"), 3)
    assert tables.read_spool(spark, str(tmp_path / "spool")).count() == 10
    assert tables.read_spool(spark, str(tmp_path / "none"), "url string").count() == 0
    assert tables.next_sequence(spark.createDataFrame([("seg-0007.pdoc",)], "name string")).first()["next"] == 8


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.example/", 0, "text/html", "<p>ü</p>"), ("https://b.example/", -1, None, "")], "url string, fetched_at long, content_type string, body string")
    WarcSink.register(spark)
    pages.write.format("seek_warc").mode("append").save(str(tmp_path / "warc"))
    got = [r for p in (tmp_path / "warc").iterdir() for r in read_warc(p) if r["WARC-Type"] == "response"]
    assert [(r["WARC-Target-URI"], r["WARC-Date"], r["body"]) for r in sorted(got, key=lambda r: r["WARC-Target-URI"])] == [("https://a.example/", "1970-01-01T00:00:00Z", "<p>ü</p>".encode()), ("https://b.example/", "1969-12-31T23:59:59Z", b"")]
