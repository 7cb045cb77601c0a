import pytest
from pyspark.sql import functions as F

from seekspark.config import GraphConfig, SearchConfig
from seekspark.errors import IncompatibleSchema, LimitError, MissingIndex, QueryParseError
from seekspark.operators import graph, ranking
from seekspark.operators.engine import IndexWriter, SearchEngine, SearchIndex
from seekspark.plans.query_parser import Leaf, Node, parse
from seekspark.streaming.drain import drain

DOCS = [
    ("https://a.example/rust", "Ownership in Rust", "Each value has an owner. Borrowing lends it out.", 100),
    ("https://b.example/python", "The lock of Python", "One lock guards the interpreter.", 100),
    ("https://a.example/async", "Async Rust", "Futures are polled. A value may wait.", 100),
]
SCHEMA = "url string, title string, body string, fetched_at long"


def test_parse():
    assert parse("a b") == Node("and", (Leaf(("a",)), Leaf(("b",))))
    assert parse("a OR b") == Node("or", (Leaf(("a",)), Leaf(("b",))))
    assert parse('title:"x y" -z') == Node("and", (Leaf(("x", "y"), "title"),), (Leaf(("z",)),))
    assert parse("a (b OR +c)") == Node("and", (Leaf(("a",)), Node("or", (Leaf(("b",)), Leaf(("c",))))))
    assert parse("...") is None
    for bad in ('"open', "(a", "a)", "nofield:x", "OR a"):
        with pytest.raises(QueryParseError):
            parse(bad)


def test_parse_ranges_sets_and_boosts():
    assert parse("a^2.5") == Leaf(("a",), boost=2.5) and parse('"a b"^3') == Leaf(("a", "b"), boost=3.0)
    assert parse("body:[a TO m}") == Leaf((), "body", bounds=("a", "m", True, False)) and parse("{* TO B]") == Leaf((), bounds=(None, "b", False, True))
    assert parse("title: IN [x Y x]") == Leaf(("x", "y"), "title", among=True)
    assert parse("(a OR b^2)^3 c") == Node("and", (Node("or", (Leaf(("a",), boost=3.0), Leaf(("b",), boost=6.0))), Leaf(("c",))))
    assert parse("url: IN [https://a/ https://b/]") == Leaf(("https://a/", "https://b/"), "url", among=True)
    with pytest.raises(QueryParseError):
        parse("nofield:[a TO b]")


def test_ranges_sets_and_boosts(spark):
    index = SearchIndex.over(spark.createDataFrame(DOCS, SCHEMA))
    urls_of = lambda q: sorted(r[1].rsplit("/", 1)[1] for r in index.search(q).rows)
    assert urls_of("body:[futures TO guards]") == ["async", "python"] and urls_of("body:{futures TO guards}") == [] and urls_of("title:[r TO *]") == ["async", "python", "rust"]
    assert urls_of("title: IN [rust python] -async") == ["python", "rust"] and urls_of("body: IN [nothing]") == []
    plain, more = (dict((r[1], r[5]) for r in index.search(q).rows) for q in ("rust OR lock", "rust^2 OR lock"))
    assert all(abs(more[u] - plain[u] * (2 if "a.example" in u else 1)) < 1e-9 for u in plain) and {r[5] for r in index.search("title: IN [rust]^4").rows} == {4.0}


def test_index(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(MissingIndex):
        SearchIndex.open(spark, path)
    writer = IndexWriter(spark, path, commit_docs=3)
    writer.add_or_update(spark.createDataFrame(DOCS, SCHEMA))
    assert writer.should_commit() and writer.commit() == 3
    index = SearchIndex.open(spark, path)
    assert index.search("rust").total_matches == 2 and not index.search("rust").relaxed
    assert index.search("rust").cached
    assert [r["url"] for r in index.search("value owner").hits.collect()] == ["https://a.example/rust"]
    loose = index.search("owner interpreter")
    assert loose.relaxed and loose.total_matches == 2
    assert index.search("nothing").total_matches == 0 and index.search("nothing").hits.isEmpty()
    assert index.search("rust", limit=0).hits.count() == 1 and index.search("rust", limit=1).total_matches == 2
    assert index.search('"an owner"').total_matches == 1 and index.search('"owner an"').total_matches == 0
    assert index.search("title:rust -async").total_matches == 1
    writer.add_or_update(spark.createDataFrame([("https://a.example/rust", "Old", "gone", 150), ("https://a.example/rust", "New", "fresh words", 200), ("https://c.example/", "More", "value", 1)], SCHEMA))
    assert index.search("owner").total_matches == 1
    assert writer.commit() == 1 and writer.doc_count() == 4 and writer.documents().count() == 4
    assert index.search("owner").total_matches == 0 and index.search("fresh").total_matches == 1 and not index.search("gone").total_matches


def test_url_field(spark):
    index = SearchIndex.over(spark.createDataFrame(DOCS, SCHEMA))
    assert [r[1] for r in index.search("url:https://a.example/rust").rows] == ["https://a.example/rust"]
    assert index.search("url:https://a.example/").total_matches == 0 and index.search("url:https://a.example/rust OR lock").total_matches == 2
    assert index.search("-rust").total_matches == 0


def size_of(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_commits_add_and_merge(spark, tmp_path, monkeypatch):
    from seekspark.operators import engine

    monkeypatch.setattr(engine, "FANOUT", 3)
    path, want = tmp_path / "index", {}
    writer = IndexWriter(spark, str(path))
    writer.add_or_update(spark.createDataFrame([(f"https://h{i % 7}.example/{i}", f"Title {i}", f"alpha beta w{i} " + "filler text " * 50, i) for i in range(3000)], SCHEMA))
    assert writer.commit() == 3000
    whole, was = size_of(path), writer.meta()
    writer.add_or_update(spark.createDataFrame([(f"https://h{i % 7}.example/{i}", "New", f"gamma n{i}", 9000 + i) for i in range(5)] + [("https://new.example/", "New", "alpha", 1)], SCHEMA))
    assert writer.commit() == 1 and size_of(path) - whole < whole / 20
    index = SearchIndex.open(spark, str(path))
    assert index.search("alpha").total_matches == 2996 and index.search("gamma").total_matches == 5 and index.doc_count() == 3001
    fresh = {r["field"]: r["avgdl"] for r in index.tables()[2].collect()}
    real = writer.documents().selectExpr("avg(size(split(trim(body), ' '))) AS a").first()["a"]
    assert abs(fresh["body"] - real) < 1e-9
    before = [tuple(r)[1:] for r in index.search("w17 OR gamma", limit=20).rows]
    writer.add_or_update(spark.createDataFrame([("https://h0.example/0", "Newer", "delta", 9999)], SCHEMA))
    assert writer.commit() == 0 and len(writer.meta()["segments"]) == 1, "three segments of a level are one of the next"
    after = index.search("delta")
    assert after.total_matches == 1 and index.search("gamma").total_matches == 4 and writer.doc_count() == 3001
    assert {r[1] for r in index.search("w17 OR gamma", limit=20).rows} == {r[0] for r in before} - {"https://h0.example/0"}
    assert index.search("alpha").total_matches == 2996 and not writer.meta()["dead"] and was["version"] == 1
    assert writer.vacuum(1) and index.search("delta").total_matches == 1 and writer.documents().count() == 3001
    assert index.warm_up() > 0 and index.search("delta", limit=3).total_matches == 1


def test_schema_check(spark):
    from seekspark.operators.engine import check_schema

    with pytest.raises(IncompatibleSchema):
        check_schema(spark.createDataFrame(DOCS, SCHEMA))


def test_engine(spark):
    rows = [(f"https://s{i % 3}.example/p/{i}", f"Title {i}", "alpha beta", 1_700_000_000) for i in range(12)] + [("https://alpha.example/", "Home", "alpha", 1_700_000_000)]
    engine = SearchEngine.over(spark.createDataFrame(rows, SCHEMA))
    first = engine.search("alpha", limit=5, now=1_700_000_000)
    urls = [r["url"] for r in engine.page(first).collect()]
    assert urls[0] == "https://alpha.example/" and len(urls) == 5 and first.total_matches == 13
    assert max(sum(f"s{i}." in u for u in urls) for i in range(3)) <= 2
    assert engine.queries().count() == 1 and engine.recorded == 1
    with pytest.raises(LimitError):
        engine.search("x", limit=101)
    with pytest.raises(ValueError):
        engine.search("")
    plain = SearchEngine(engine.index, SearchConfig(ranking_enabled=False)).search("alpha", limit=4)
    assert plain.pages is None and plain.hits.count() == 4
    assert engine.candidates(10, 0) == 150 and engine.candidates(60, 0) == 240 and engine.candidates(100, 100) == 400


def pool(spark, hosts):
    return spark.createDataFrame([(i, h, i) for i, h in enumerate(hosts, 1)], "id int, host string, place int")


@pytest.mark.parametrize("n, limit, cap, pages, last", [(9, 3, 2, 5, 1), (10, 4, 2, 5, 2)])
def test_page_walk(spark, n, limit, cap, pages, last):
    out = ranking.page_numbers(pool(spark, ["one"] * n), limit, cap).groupBy("page").count().orderBy("page").collect()
    assert len(out) == pages and out[-1]["count"] == last


def test_held_back(spark):
    rows = [{"id": i, "host": "one"} for i in range(10)]
    page = ranking.take_page(rows, 4, 0, 2)
    assert len(page.hits) == 2 and page.held_back == 8 and page.pages == 5
    whole = ranking.cap_hosts(pool(spark, ["a"] * 5 + ["b"] * 5), 2)
    assert whole.count() == 4
    every = ranking.take_page([{"host": h} for h in "aaaaabbbbb"], None, 0, 2)
    assert len(every.hits) == 4 and every.held_back == 6 and every.pages == 1
    assert ranking.take_page([], 10) == ranking.Page([], 0, 0)
    assert ranking.take_page(rows, 4, 4, None).hits == rows[4:8]


def passes(hosts, limit, cap):
    """Pages as passes over the rest, with what each holds back before it is full."""
    left, page, want, held = list(enumerate(hosts)), 0, {}, []
    while left:
        page, taken, counts, rest = page + 1, 0, {}, []
        held.append(0)
        for i, h in left:
            if taken < limit and counts.get(h, 0) < cap:
                taken, counts[h] = taken + 1, counts.get(h, 0) + 1
                want[i] = page, taken
            else:
                rest.append((i, h))
                held[-1] += taken < limit
        left = rest
    return [want[i] for i in range(len(hosts))], held


def test_first_fit_is_the_passes():
    import random

    rng = random.Random(9)
    for _ in range(400):
        hosts = [rng.choice("aaabcdefgh"[: rng.randint(1, 10)]) for _ in range(rng.randint(0, 60))]
        limit, cap = rng.randint(1, 8), rng.randint(1, 4)
        want, held = passes(hosts, limit, cap)
        assert ranking.first_fit(hosts, limit, cap) == want
        for k, n in enumerate(held):
            page = ranking.take_page([{"host": h} for h in hosts], limit, k * limit, cap)
            assert page.held_back == n and page.pages == len(held)
    assert len(ranking.first_fit(["one"] * 100_000, 10, 2)) == 100_000


def test_page_walk_greedy(spark):
    import random

    rng = random.Random(4)
    for _ in range(3):
        hosts = [rng.choice("abcd") for _ in range(25)]
        got = {r["id"]: r["page"] for r in ranking.page_numbers(pool(spark, hosts), 6, 2).collect()}
        left, page, want = list(enumerate(hosts, 1)), 0, {}
        while left:
            page, taken, counts, rest = page + 1, 0, {}, []
            for i, h in left:
                if taken < 6 and counts.get(h, 0) < 2:
                    want[i], taken, counts[h] = page, taken + 1, counts.get(h, 0) + 1
                else:
                    rest.append((i, h))
            left = rest
        assert got == want


def test_graph(spark):
    edges = spark.createDataFrame([("https://h.example/" + a, "https://h.example/" + b) for a, b in [("1", ""), ("2", ""), ("3", ""), ("", "about"), ("", "privacy")]], "src string, dst string")
    one = {r["node"]: r["rank"] for r in graph.pagerank(edges).collect()}
    two = {r["node"]: r["rank"] for r in graph.pagerank(edges, c=GraphConfig(iterations=20), distributed=True).collect()}
    assert abs(sum(one.values()) - 1) < 1e-9 and all(abs(one[k] - two[k]) < 1e-12 for k in one)
    assert one["https://h.example/"] > one["https://h.example/privacy"]
    squashed = spark.range(1).select(*(graph.squash(F.lit(v), s).alias(n) for n, v, s in (("a", 0.0, 4.0), ("b", -5.0, 4.0), ("c", 5.0, 0.0)))).first()
    assert tuple(squashed) == (0.0, 0.0, 0.0)


def test_links_of_last_record(spark):
    pages = spark.createDataFrame([("p", ["a", "a", "p"], 1), ("p", ["b"], 2)], "url string, links array<string>, seq long")
    assert [tuple(r) for r in graph.link_edges(pages, seq="seq").collect()] == [("p", "b")]


def test_drain(spark, tmp_path):
    rows = [(u, t, b, at, ["https://b.example/python"] if "rust" in u else []) for u, t, b, at in DOCS]
    docs = spark.createDataFrame(rows, SCHEMA + ", outlinks array<string>")
    docs.write.parquet(str(tmp_path / "spool"))
    report = drain(spark, str(tmp_path / "spool"), str(tmp_path / "index"), str(tmp_path / "state"), clock=lambda: 960)
    assert report.gained == 3 and report.edges >= 1 and report.gains[0][0] == 960
    again = drain(spark, str(tmp_path / "spool"), str(tmp_path / "index"), str(tmp_path / "state"))
    assert again.batches == 0
    hit = SearchIndex.open(spark, str(tmp_path / "index")).search("interpreter").hits.first()
    assert hit["authority"] > 0 and 0 < hit["host_authority"] < 1


def _posted(df):
    return sorted((r["id"] or "", r["term"], r["tf"], r["positions"], r["dl"]) for r in df.collect())


def test_postings_are_grouped_inside_rows(spark):
    from seekspark.operators import search

    docs = spark.createDataFrame([("a", "x y X z x"), ("b", ""), ("c", None), ("d", "Z")], "id string, body string")
    plan = search.postings(docs, "id", ("body",), unique=True)
    assert _posted(plan) == [("a", "x", 3, [0, 2, 4], 5), ("a", "y", 1, [1], 5), ("a", "z", 1, [3], 5), ("d", "z", 1, [0], 1)]
    assert "Aggregate" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert _posted(search.postings(docs, "id", ("body",), asked=lambda t: t == "z")) == [("a", "z", 1, [3], 5), ("d", "z", 1, [0], 1)]


def test_postings_of_one_id_in_several_rows(spark):
    from seekspark.operators import search

    docs = spark.createDataFrame([("a", "x y"), ("a", "x z"), (None, "n"), (None, "n"), ("b", "x")], "id string, body string")
    assert _posted(search.postings(docs, "id", ("body",))) == [("", "n", 2, [0, 0], 1), ("a", "x", 2, [0, 0], 2), ("a", "y", 1, [1], 2), ("a", "z", 1, [1], 2), ("b", "x", 1, [0], 1)]


def test_a_query_makes_its_own_postings_alone(spark):
    index = SearchIndex.over(spark.createDataFrame(DOCS, SCHEMA))
    assert index._tables[1] is None and index.search("rust").total_matches == 2
    assert index.warm_up() > 0 and index._tables[1].is_cached and index.search("rust value").total_matches == 2
