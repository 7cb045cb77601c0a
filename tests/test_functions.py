import gzip

import pytest
from pyspark.sql import functions as F

from seekspark.functions import fetching, html, robots, urls
from seekspark.functions.text import cut_snippet, tokens


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("https://Example.COM:443/p#section", "https://example.com/p"), ("https://s.example/p?utm_source=news&id=7&utm_medium=email", "https://s.example/p?id=7"),
        ("https://s.example/s?q=a+b,c&x=1", "https://s.example/s?q=a+b,c&x=1"), ("https://s.example/p?fbclid=1", "https://s.example/p"), ("https://s.example/p?", "https://s.example/p?"),
        ("https://s.example/p?fbclid=1&a=x y", "https://s.example/p?a=x+y"), ("mailto:a@b.example", None), (None, None),
    ],
)
def test_canonical(spark, given, wanted):
    assert one(spark, given, urls.canonical_url) == wanted


def test_quality(spark):
    score = lambda u: round(one(spark, u, urls.url_quality), 6)
    assert score("https://a.example/") == 1.15
    assert score("https://a.example/privacy") == 0.3
    assert score("https://a.example/en-us/x") == 0.55
    assert score("https://a.example/a/b/c/d") == round(0.93**2, 6)
    with pytest.raises(ValueError):
        urls.url_quality(F.col("x"), legal=0)


def test_entities():
    assert html.decode("&amp;&mdash;&#65;&#x42;&nope;& &toolongentityname;&lang;") == "&—AB&nope;& &toolongentityname;⟨"


def test_extraction():
    page = "<html><head><title> A &amp;\n B </title><title>no</title><meta name=description content=' d  e '></head><body><header>h</header>x<b>y</b><script>s</script><a href='../z?q#f'>l</a><a href='#t'></a><a href='mailto:m@x.example'></a></body></html>"
    assert html.extract(page, "https://e.example/a/b/c") == ("A & B", "x y l", ["https://e.example/a/z?q"], "d e")
    assert html.extract("plain", "https://e.example/") == ("https://e.example/", "", [], None)
    assert html.extract(None, None) == ("", "", [], None)
    assert html.extract("<base href='https://o.example/x/'><a href=y>", "https://e.example/")[2] == ["https://o.example/x/y"]


def test_whitespace(spark):
    assert one(spark, " a   b\n", html.collapse_whitespace) == "a b"


def test_robots_groups():
    body = "User-agent: *\nDisallow: /\n\nUser-agent: seekbot\nAllow: /\nCrawl-delay: 2.1"
    assert robots.parse(body, "SeekBot/2") == {"crawl_delay_s": 3, "disallow": [], "allow": ["/"], "sitemaps": []}
    assert robots.parse(body, "other")["disallow"] == ["/"]
    assert robots.parse(None, "x") == {"crawl_delay_s": None, "disallow": [], "allow": [], "sitemaps": []}


def test_robots_ties_disallow(spark):
    rules = spark.createDataFrame([("h", "/a", True), ("h", "/a", False), ("h", "/b*c$", False)], "host string, pattern string, is_allow boolean")
    paths = spark.createDataFrame([("h", "/a/x"), ("h", "/b/c"), ("h", "/b/cd"), ("g", "/a")], "host string, path string")
    assert {r["path"]: r["allowed"] for r in robots.allowed(paths, rules).filter("host = 'h'").collect()} == {"/a/x": False, "/b/c": False, "/b/cd": True}


def test_content_hash(spark):
    assert one(spark, "hello world", fetching.content_hash) == -3150353794653054837
    assert one(spark, None, fetching.content_hash) is None


def test_decode():
    assert fetching.decode(gzip.compress("é".encode("latin-1")), "latin-1") == "é"
    assert fetching.decode(b"\xff", "nonsense") == "�"
    assert fetching.decode(None, None) is None


def test_retry(spark):
    df = spark.createDataFrame([(40_000, 250), (None, 250), (500, 250)], "after long, wait long")
    got = df.select(fetching.retry_delay_ms(F.col("after"), F.col("wait"), F.lit(10)).alias("d")).collect()
    assert [r["d"] for r in got] == [None, 260, 500]


def test_tokens(spark):
    assert one(spark, "The C++ Über-café " + "x" * 40, tokens) == ["the", "c", "über", "café"]
    assert one(spark, None, tokens) == []


def test_snippet():
    body = "lead " * 100 + "the <gil> is here " + "tail " * 100
    cut = cut_snippet(body, {"gil": 2.0, "tail": 0.1})
    assert "&lt;<b>gil</b>&gt;" in cut and len(cut.replace("<b>", "").replace("</b>", "")) < 270
    assert cut_snippet(None, {"a": 1.0}) == ""


def test_safe_snippet():
    assert fetching.safe_text("a &lt;i&gt; <b>x</b> <script>") == "a &lt;i&gt; <b>x</b> &lt;script&gt;"


def test_powers_to_the_last_bit(spark):
    from seekspark.operators import ranking

    ages = spark.range(400).select(F.col("id"), ranking.freshness(F.lit(1.0), F.lit(0) - F.col("id") * 86400, 0.0).alias("x")).collect()
    assert all(r["x"] == 0.5 ** (r["id"] / 30) for r in ages)
    deep = {n: one(spark, "https://a.example/" + "x/" * n, urls.url_quality) for n in (3, 6, 9, 10, 11, 40)}
    assert deep == {n: max(0.55, 0.93 ** (n - 2)) for n in deep}


def test_authorities_are_weighted_before_they_are_divided(spark):
    from seekspark.config import RankingConfig
    from seekspark.operators import ranking

    rows = spark.range(1, 7).select("id", F.lit("https://a.example/x").alias("url"), F.lit("").alias("title"), F.col("id").cast("double").alias("authority"), F.lit(0.0).alias("host_authority"))
    got = {r["id"]: r["s"] for r in rows.select("id", ranking.importance(F.lit(0.0), "the and", RankingConfig(authority_of=7.0)).alias("s")).collect()}
    assert got == {k: 2.5 * k / 7 for k in range(1, 7)}


def test_years_of_five_digits(spark):
    from seekspark.functions.phrases import format_date

    assert one(spark, 518_394_000_000, format_date, "long") == "02 Apr 18397, 13:20 UTC" and one(spark, 86399, format_date, "long") == "01 Jan 1970, 23:59 UTC"
    assert one(spark, -62_135_596_800, format_date, "long") == "01 Jan 0001, 00:00 UTC"


def test_a_reference_ends_with_a_semicolon():
    assert fetching.safe_text("<b>a&amp</b> &amp; &apos; &#60; &nosuch; &") == "<b>a&amp;amp</b> &amp; &#x27; &lt; &amp;nosuch; &amp;"


def test_pages_go_to_python_in_small_batches(spark):
    """Arrow sends 10,000 rows or 64 MB of pages at once; the rows come back the same, odd ones too."""
    pages = [(None, None), (None, "https://e.example/"), ("", ""), ("<title>a\U0001f600\0é</title><body>x&mdash; y<a href=z>", "https://e.example/q"), ("<body>" + "w " * 500_000, "https://e.example/long")] * 50
    found = spark.createDataFrame(pages, "html string, url string").select(html.extract_page("html", "url").alias("p"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [tuple(r["p"]) for r in found.collect()] == [html.extract(*p) for p in pages[:5]] * 50
