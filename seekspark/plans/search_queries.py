"""Tokens, postings, BM25, ranking and pages of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekspark.config import RankingConfig
from seekspark.functions import html, urls
from seekspark.functions.text import cut_snippet, snippet, tokens
from seekspark.operators import ranking, search
from seekspark.plans.query_parser import all_leaves, parse
from seekspark.plans.registry import FETCHED_SQL, NOW, Registry, fetched_at
from seekspark.plans.url_queries import BODY_TEXT, CANONICAL, LABEL, QUALITY, RANK_HOST, SEGMENTS, TITLE, TITLE_TEXT
from seekspark.sources.tables import table

REGISTRY = Registry()
BODY = ("body",)
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND strlen(t) < 40)"
_WORDS = f"(SELECT doc_id, unnest({_TOKENS}) AS term FROM documents)"
_POSTED = f"(SELECT doc_id, term, count(*)::BIGINT AS tf FROM {_WORDS} GROUP BY ALL)"
_LENGTHS = f"(SELECT doc_id, len({_TOKENS})::BIGINT AS dl FROM documents)"


def _bm25(terms: list[str], need: str) -> str:
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""(WITH p AS MATERIALIZED (SELECT * FROM {_POSTED} WHERE term IN ({wanted})), l AS MATERIALIZED (SELECT * FROM {_LENGTHS}), d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
        SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM p JOIN d USING (term) JOIN l USING (doc_id), (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM l) GROUP BY doc_id HAVING count(DISTINCT term) {need})"""


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))


def index_of(spark, sf_dir, query: str | None = None):
    """Postings, of a query's own terms if there is one, and field statistics."""
    docs = corpus(spark, sf_dir)
    own = None if query is None else search.asked(all_leaves(parse(query)))
    return search.postings(docs, "doc_id", BODY, own), search.field_stats(search.doc_lengths(docs, "doc_id", BODY))


@REGISTRY.query(f"SELECT doc_id, len({_TOKENS})::BIGINT AS n_tokens, array_to_string({_TOKENS}, ' ') AS tokens FROM documents")
def q_tokenize(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.size(tokens(F.col("body"))).alias("n_tokens"), F.array_join(tokens(F.col("body")), " ").alias("tokens"))


@REGISTRY.query(f"SELECT * FROM {_POSTED}")
def q_postings(spark, sf_dir):
    return index_of(spark, sf_dir)[0].select(F.col("id").alias("doc_id"), "term", "tf")


@REGISTRY.query(f"SELECT * FROM {_LENGTHS}")
def q_doc_len(spark, sf_dir):
    return search.doc_lengths(corpus(spark, sf_dir), "doc_id", BODY).select(F.col("id").alias("doc_id"), "dl")


@REGISTRY.query(f"SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM {_POSTED} GROUP BY term")
def q_term_stats(spark, sf_dir):
    return search.term_stats(index_of(spark, sf_dir)[0]).select("term", "df", "cf")


def _scores(spark, sf_dir, query: str, default: str = "and"):
    return search.scored(*index_of(spark, sf_dir, query), parse(query, default), BODY).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@REGISTRY.query(f"SELECT doc_id, round(score, 6) AS score FROM {_bm25(['the', 'and'], '= 2')}")
def q_bm25_and(spark, sf_dir):
    return _scores(spark, sf_dir, "The and")


@REGISTRY.query(f"SELECT doc_id, round(score, 6) AS score FROM {_bm25(['the', 'und'], '>= 1')}")
def q_bm25_or(spark, sf_dir):
    return _scores(spark, sf_dir, "the OR und")


@REGISTRY.query(f"SELECT doc_id, round(score, 6) AS score FROM {_bm25(['the', 'qqqzz'], '>= 1')}")
def q_relax(spark, sf_dir):
    hits = search.match(*index_of(spark, sf_dir, "the qqqzz"), "the qqqzz", BODY)
    return hits.hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@REGISTRY.query(f"SELECT count(*)::BIGINT AS total FROM {_bm25(['the', 'and'], '= 2')}")
def q_match_count(spark, sf_dir):
    total = search.match(*index_of(spark, sf_dir, "the and"), "the and", BODY).total
    return spark.createDataFrame([(total,)], "total long")


@REGISTRY.query(f"SELECT doc_id, round(score, 6) AS score FROM {_bm25(['the', 'and'], '= 2')} ORDER BY score DESC, doc_id LIMIT 20 OFFSET 10")
def q_top_k(spark, sf_dir):
    hits = search.scored(*index_of(spark, sf_dir, "the and"), parse("the and"), BODY)
    return search.top(hits, 20, 10).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@REGISTRY.query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' of the ') AND NOT contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' is ')")
def q_phrase_and_not(spark, sf_dir):
    return _scores(spark, sf_dir, '"of the" -is').select("doc_id")


_MATCH = lambda terms, html="html": f"""(CASE WHEN len(regexp_extract_all(lower({TITLE}), '[a-z0-9]+')) = 0 THEN 0 ELSE least(1, len(list_intersect(list_distinct(regexp_extract_all(lower({TITLE}), '[a-z0-9]+')), {terms})) / len(regexp_extract_all(lower({TITLE}), '[a-z0-9]+'))) END)"""
_SCORE = "(2 + (page_id % 80) / 10)"
_FRESH = f"({_SCORE} * pow(0.5::DOUBLE, greatest(0, ({NOW} - {FETCHED_SQL}) / 86400) / 30))"
_QUERY = "the and thonre"
_POOL = f"""(SELECT *, {_FRESH} * {QUALITY} + 2.5 * (page_id % 7) / 7 + 1.5 * (page_id % 5) / 5 + 2.0 * {_MATCH("['the', 'and', 'thonre']")}
    + CASE WHEN {LABEL} IN ('the', 'and', 'thonre') AND len({SEGMENTS}) > 0 THEN 1.2 ELSE 0 END AS score, {RANK_HOST} AS host, lower(trim(regexp_replace({TITLE}, '\\s+', ' ', 'g'))) AS norm FROM pages)"""
_COLLAPSED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, norm, page_id % 2 ORDER BY score DESC, page_id) AS n FROM {_POOL}) WHERE n = 1)"
_ORDERED = f"(SELECT *, row_number() OVER (ORDER BY score DESC, page_id) AS place FROM {_COLLAPSED})"
_LIMIT, _CAP = 10, 2


#: Authorities come as parts of 7 and 5, so that they are weighted before they are divided, as in the twin: equal scores stay equal to the last bit.
_PARTS = RankingConfig(authority_of=7.0, host_authority_of=5.0)


def _hits(spark, sf_dir):
    i = F.col("page_id")
    score, authority, host_authority = 2 + (i % 80) / 10, (i % 7).cast("double"), (i % 5).cast("double")
    return table(spark, sf_dir, "pages").select("page_id", "url", html.raw_title(F.col("html")).alias("title"), (i % 2).cast("string").alias("snippet"), fetched_at().alias("fetched_at"), score.alias("score"), authority.alias("authority"), host_authority.alias("host_authority"), i.alias("engine_rank"))


def _pool(spark, sf_dir):
    return ranking.ordered_pool(_hits(spark, sf_dir), _QUERY, NOW, _PARTS)


@REGISTRY.query(f"SELECT page_id, round({_FRESH}, 6) AS score FROM pages")
def q_freshness(spark, sf_dir):
    return _hits(spark, sf_dir).select("page_id", F.round(ranking.freshness(F.col("score"), F.col("fetched_at"), NOW), 6).alias("score"))


@REGISTRY.query(f"SELECT page_id, round(score, 6) AS score FROM {_POOL}")
def q_importance(spark, sf_dir):
    fresh = _hits(spark, sf_dir).withColumn("score", ranking.freshness(F.col("score"), F.col("fetched_at"), NOW))
    return fresh.select("page_id", F.round(ranking.importance(F.col("score"), _QUERY, _PARTS), 6).alias("score"))


@REGISTRY.query(f"SELECT page_id, round(score, 6) AS score, place FROM {_ORDERED}")
def q_rank_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select("page_id", F.round("score", 6).alias("score"), "place")


@REGISTRY.query(f"SELECT host, count(*)::BIGINT AS hits, count(DISTINCT norm || (page_id % 2)::VARCHAR)::BIGINT AS different FROM {_POOL} GROUP BY host")
def q_collapse_dups(spark, sf_dir):
    host = urls.rank_host(F.col("url")).alias("host")
    all_hits = _hits(spark, sf_dir).groupBy(host).agg(F.count("*").alias("hits"))
    return all_hits.join(_pool(spark, sf_dir).groupBy(host).agg(F.count("*").alias("different")), "host")


@REGISTRY.query(f"SELECT page_id, place FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY place) AS h FROM {_ORDERED}) WHERE h <= {_CAP}")
def q_domain_cap(spark, sf_dir):
    pool = _pool(spark, sf_dir).withColumn("host", urls.rank_host(F.col("url")))
    return ranking.cap_hosts(pool, _CAP).select("page_id", "place")


#: The passes of the page walk: what a pass leaves goes into the next, until nothing is left.
_WALK = f"""WITH RECURSIVE w AS (SELECT page_id, host, place, 0::BIGINT AS pass, NULL::BIGINT AS page, NULL::BIGINT AS slot FROM {_ORDERED} UNION ALL
    SELECT page_id, host, place, pass + 1, CASE WHEN h <= {_CAP} AND s <= {_LIMIT} THEN pass + 1 END, CASE WHEN h <= {_CAP} AND s <= {_LIMIT} THEN s END
    FROM (SELECT *, sum((h <= {_CAP})::INT) OVER (ORDER BY place) AS s FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY place) AS h FROM w WHERE page IS NULL)))"""


def _paged(spark, sf_dir):
    return _pool(spark, sf_dir).withColumn("host", urls.rank_host(F.col("url"))).select("page_id", "host", "place")


@REGISTRY.query(_WALK + " SELECT page_id, page, slot FROM w WHERE page IS NOT NULL")
def q_pages(spark, sf_dir):
    """Every page of the whole pool."""
    return ranking.page_numbers(_paged(spark, sf_dir), _LIMIT, _CAP).select("page_id", "page", "slot")


_SECOND = f"(SELECT max(place) AS last, count(*) AS n FROM w WHERE page = 2)"


@REGISTRY.query(_WALK + f""" SELECT (SELECT n FROM {_SECOND})::BIGINT AS on_page, (SELECT max(page) FROM w)::BIGINT AS pages, count(*) FILTER (page > 2 AND ((SELECT n FROM {_SECOND}) < {_LIMIT} OR place < (SELECT last FROM {_SECOND})))::BIGINT AS held_back FROM w WHERE page IS NOT NULL""")
def q_held_back(spark, sf_dir):
    """The second page: its hits, those passed over before it was full, and how many pages there are."""
    page = ranking.take_page(_paged(spark, sf_dir).orderBy("place").collect(), _LIMIT, _LIMIT, _CAP)
    return spark.createDataFrame([(len(page.hits), page.held_back, page.pages)], "on_page long, held_back long, pages long")


@REGISTRY.query(f"SELECT count(*) FILTER (h <= {_CAP})::BIGINT AS kept, ((SELECT count(*) FROM pages) - count(*) FILTER (h <= {_CAP}))::BIGINT AS suppressed FROM (SELECT row_number() OVER (PARTITION BY host ORDER BY place) AS h FROM {_ORDERED})")
def q_rank(spark, sf_dir):
    """The whole policy over all hits, capped once: what is kept, and what duplicates and the cap took."""
    kept, suppressed = ranking.rank(_hits(spark, sf_dir), _QUERY, NOW, _PARTS)
    return kept.agg(F.count("*").alias("kept")).withColumn("suppressed", F.lit(suppressed).cast("long"))


_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


def _snippets(hits: str) -> str:
    """SQL of (k, snippet) for a query of (k, text): the stretch with most different terms, moved to the middle, ends moved to white space, escaped, terms marked."""
    return f"""WITH hits AS MATERIALIZED ({hits}),
    p AS (SELECT k, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT k, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS w FROM hits)),
    q AS MATERIALIZED (SELECT *, coalesce(sum(length(w)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, lower(w) IN ('the', 'and') AS hit FROM p),
    s AS MATERIALIZED (SELECT k, lower(w) AS t, a, a + length(w) AS b FROM q WHERE hit),
    v AS (SELECT x.k, x.a, count(DISTINCT y.t) AS weight, max(y.b) AS last FROM s x JOIN s y ON x.k = y.k AND y.a >= x.a AND y.b <= x.a + 240 GROUP BY ALL),
    c AS (SELECT k, text, length(text) AS n, first.last AS last, greatest(0, least(first.a - (240 - (first.last - first.a)) // 2, length(text) - 240)) AS a0 FROM (SELECT k, arg_min(struct_pack(a := a, last := last), (-weight, a)) AS first FROM v GROUP BY k) JOIN hits USING (k)),
    d AS (SELECT *, CASE WHEN a0 > 0 AND NOT regexp_matches(substr(text, a0, 1), '\\s') THEN a0 + length(regexp_extract(substr(text, a0 + 1), '^[^\\s]*\\s')) ELSE a0 END AS a1 FROM c),
    e AS (SELECT *, least(n, a1 + 240) AS b0, substr(text, a1 + 2, least(n, a1 + 240) - a1) AS mid FROM d),
    f AS (SELECT *, CASE WHEN b0 < n AND NOT regexp_matches(substr(text, b0 + 1, 1), '\\s') THEN greatest(last, CASE WHEN regexp_matches(mid, '\\s') THEN a1 + 1 + length(regexp_extract(mid, '(?s)^(.*)\\s', 1)) ELSE b0 END) ELSE b0 END AS b1 FROM e),
    g AS (SELECT k, i, hit AND a >= a1 AND a + length(w) <= b1 AS marked, substr(w, greatest(a1 - a, 0) + 1, least(b1, a + length(w)) - greatest(a1, a)) AS w FROM q JOIN f USING (k) WHERE a + length(w) > a1 AND a < b1)
    SELECT k, trim(string_agg(CASE WHEN marked THEN '<b>' || {_ESCAPED.format('w')} || '</b>' ELSE {_ESCAPED.format('w')} END, '' ORDER BY i), ' ' || chr(10) || chr(9) || chr(13)) AS snippet FROM g GROUP BY k"""


_TWENTY = f"SELECT doc_id AS k, text FROM (SELECT doc_id FROM {_bm25(['the', 'and'], '= 2')} ORDER BY score DESC, doc_id LIMIT 20) JOIN documents USING (doc_id)"


@REGISTRY.query(f"SELECT k AS doc_id, snippet FROM ({_snippets(_TWENTY)})")
def q_snippet(spark, sf_dir):
    hits = search.top(search.scored(*index_of(spark, sf_dir, "the and"), parse("the and"), BODY), 20)
    return F.broadcast(hits).join(corpus(spark, sf_dir), F.col("id") == F.col("doc_id")).select("doc_id", snippet(F.col("body"), {"the": 1.0, "and": 1.0}).alias("snippet"))  # 20 rows


_FOUND = f"""(WITH d AS MATERIALIZED (SELECT c.canonical AS url, p.page_id, {TITLE_TEXT} AS title, {BODY_TEXT} AS body, {FETCHED_SQL} AS fetched_at FROM pages p JOIN {CANONICAL} c USING (page_id)),
    f AS MATERIALIZED (SELECT url, page_id, 'title' AS field, {_TOKENS.replace('text', 'title')} AS words FROM d UNION ALL SELECT url, page_id, 'body', {_TOKENS.replace('text', 'body')} FROM d),
    n AS (SELECT field, count(*)::DOUBLE AS n, avg(len(words)) AS avgdl FROM f GROUP BY field),
    p AS MATERIALIZED (SELECT page_id, field, t AS term, len(list_filter(words, lambda x: x = t)) AS tf, len(words) AS dl FROM f, (SELECT unnest(['the', 'and']) AS t) WHERE list_contains(words, t)),
    s AS (SELECT page_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN (SELECT field, term, count(*) AS df FROM p GROUP BY ALL) USING (field, term) JOIN n USING (field) GROUP BY page_id HAVING count(DISTINCT term) = 2),
    h AS (SELECT url, title, body, fetched_at, score AS found FROM s JOIN d USING (page_id) ORDER BY score DESC, url LIMIT 150),
    sn AS MATERIALIZED ({_snippets('SELECT url AS k, body AS text FROM h')}),
    r AS (SELECT h.*, snippet, found * pow(0.5::DOUBLE, greatest(0, ({NOW} - fetched_at) / 86400) / 30) * {QUALITY} + 2.0 * @match + CASE WHEN {LABEL} IN ('the', 'and') AND len({SEGMENTS}) > 0 THEN 1.2 ELSE 0 END AS score, {RANK_HOST} AS host FROM h JOIN sn ON url = k),
    u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY host, lower(title), snippet ORDER BY score DESC, found DESC, url) = 1),
    o AS (SELECT *, row_number() OVER (ORDER BY score DESC, found DESC, url) AS place FROM u)
    SELECT place, url, title, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY place) AS k FROM o) WHERE k <= 2 ORDER BY place LIMIT 10)"""
_OWN_TITLE = "regexp_extract_all(lower(title), '[a-z0-9]+')"
_FOUND = _FOUND.replace("@match", f"(CASE WHEN len({_OWN_TITLE}) = 0 THEN 0 ELSE least(1, len(list_intersect(list_distinct({_OWN_TITLE}), ['the', 'and'])) / len({_OWN_TITLE})) END)")


@REGISTRY.query(f"SELECT * FROM {_FOUND}")
def q_search_flagship(spark, sf_dir):
    """Pages read, indexed in memory, searched for two terms, re-ranked: the first page of results."""
    engine, response = _flagship(spark, sf_dir)
    return engine.page(response).drop("snippet")


def _flagship(spark, sf_dir):
    from seekspark.operators.engine import SearchEngine

    pages = table(spark, sf_dir, "pages").select(urls.canonical_url(F.col("url")).alias("url"), html.extract_page("html", "url").alias("p"), fetched_at().alias("fetched_at"))
    docs = pages.select("url", "p.title", F.col("p.text").alias("body"), "fetched_at", F.col("p.links").alias("outlinks"))
    engine = SearchEngine.over(docs)
    return engine, engine.search("the and", limit=10, now=NOW)


_DOCS_BM25 = _bm25(["the", "and"], "= 2")


def _indexed(spark, sf_dir):
    """An index on disk of all documents under URLs, in three commits: all with another text at first, then two halves over it."""
    from seekspark.operators.engine import IndexWriter
    from seekspark.streaming.folders import new_folder

    path = new_folder(spark, "index")
    writer, docs = IndexWriter(spark, path), corpus(spark, sf_dir)
    as_pages = docs.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("url"), F.lit("").alias("title"), "body", F.col("doc_id").alias("fetched_at"))
    for part in (as_pages.withColumn("body", F.lit("the and of old")), as_pages.filter("fetched_at % 2 = 0"), as_pages.filter("fetched_at % 2 = 1")):
        writer.add_or_update(part)
        writer.commit()
    return path


@REGISTRY.query(f"SELECT doc_id AS fetched_at, round(score, 6) AS score FROM {_DOCS_BM25} QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 400")
def q_index_search(spark, sf_dir):
    """The widest window of hits from an index on disk whose documents were all replaced."""
    from seekspark.operators.engine import SearchIndex

    hits = SearchIndex.open(spark, _indexed(spark, sf_dir)).search("the and", 400).hits
    return hits.select("fetched_at", F.round("score", 6).alias("score"))


@REGISTRY.query(f"SELECT (SELECT count(*) FROM documents)::BIGINT AS documents, 3::BIGINT AS version, (SELECT count(*) FROM {_DOCS_BM25})::BIGINT AS total_matches, 0::BIGINT AS old_matches, round((SELECT avg(dl) FROM {_LENGTHS}), 6) AS avg_tokens")
def q_index_stats(spark, sf_dir):
    """Counts of the same index: what it says of itself, and of words that only the replaced texts had."""
    from seekspark.operators.engine import SearchIndex

    index = SearchIndex.open(spark, _indexed(spark, sf_dir))
    stats = index.stats()
    row = stats["documents"], stats["version"], index.search("the and").total_matches, index.search('"the and of old"').total_matches, round(stats["avg_tokens"]["body"], 6)
    return spark.createDataFrame([row], "documents long, version long, total_matches long, old_matches long, avg_tokens double")


@REGISTRY.query(f"SELECT doc_id AS fetched_at, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM {_DOCS_BM25} ORDER BY score DESC, doc_id LIMIT 10 OFFSET 20")
def q_plain_page(spark, sf_dir):
    """The third page with ranking switched off: a slice in the engine's own order."""
    from seekspark.config import SearchConfig
    from seekspark.operators.engine import SearchEngine, SearchIndex

    docs = corpus(spark, sf_dir).select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("url"), F.lit("").alias("title"), "body", F.col("doc_id").alias("fetched_at"))
    engine = SearchEngine(SearchIndex.over(docs), SearchConfig(ranking_enabled=False))
    return engine.search("the and", 10, 20).hits.select("fetched_at", "place")


_COUNTED = _FOUND.replace("\n    SELECT place, url, title, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY place) AS k FROM o) WHERE k <= 2 ORDER BY place LIMIT 10)", """,
    x AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY place) AS k FROM o),
    y AS (SELECT max(place) AS last FROM (SELECT place FROM x WHERE k <= 2 ORDER BY place LIMIT 10))
    SELECT (SELECT count(*) FROM s)::BIGINT AS total_matches, (SELECT count(*) FROM d)::BIGINT AS doc_count, count(*)::BIGINT AS reachable, ((SELECT count(*) FROM h) - count(*))::BIGINT AS suppressed, count(*) FILTER (k > 2 AND place < last)::BIGINT AS capped_on_page, 10::BIGINT AS returned FROM x, y)""")


@REGISTRY.query(f"SELECT * FROM {_COUNTED}")
def q_response_counters(spark, sf_dir):
    """What the flagship's response says beside its hits."""
    r = _flagship(spark, sf_dir)[1]
    return spark.createDataFrame([(r.total_matches, r.doc_count, r.reachable, r.suppressed, r.capped_on_page, r.returned)], "total_matches long, doc_count long, reachable long, suppressed long, capped_on_page long, returned long")


@REGISTRY.query("SELECT doc_id FROM documents WHERE list_has_any(" + _TOKENS + ", ['the', 'und']) AND len(list_filter(" + _TOKENS + ", lambda t: t >= 'q' AND t < 's')) > 0 AND NOT list_contains(" + _TOKENS + ", 'is')")
def q_sets_and_ranges(spark, sf_dir):
    return _scores(spark, sf_dir, "IN [the und] +[q TO s} -is^2", "and").select("doc_id")


@REGISTRY.query("SELECT (100 * (page_id % 5) + page_id % 100)::BIGINT AS skip, (1 + page_id % 100)::BIGINT AS size, least(greatest((skip + size) * 4, skip + size, 150), 400)::BIGINT AS candidates FROM pages GROUP BY ALL")
def q_candidate_window(spark, sf_dir):
    """How many hits a page at an offset asks the engine for."""
    from seekspark.operators.engine import SearchEngine

    engine = SearchEngine(None)
    pages = table(spark, sf_dir, "pages").select((100 * (F.col("page_id") % 5) + F.col("page_id") % 100).alias("skip"), (1 + F.col("page_id") % 100).alias("size")).distinct().collect()  # five hundred at most
    return spark.createDataFrame([(r["skip"], r["size"], engine.candidates(r["size"], r["skip"])) for r in pages], "skip long, size long, candidates long")


@REGISTRY.query("SELECT 0::BIGINT AS none, false AS relaxed, 1::BIGINT AS of_limit_zero, (SELECT count(*) FROM documents WHERE list_contains(" + _TOKENS + ", 'the'))::BIGINT AS after_relaxing, true AS was_relaxed")
def q_no_match(spark, sf_dir):
    """No hit for one unknown word; of two, one of them unknown, those of the other; and a limit of 0 counts as 1."""
    posted, stats = index_of(spark, sf_dir, "the qqqzz")
    nothing, loose = search.best(posted, stats, "qqqzz", 10, 0, BODY), search.best(posted, stats, "the qqqzz", 0, 0, BODY)
    return spark.createDataFrame([(nothing.total, nothing.relaxed, len(loose.rows), loose.total, loose.relaxed)], "none long, relaxed boolean, of_limit_zero long, after_relaxing long, was_relaxed boolean")
