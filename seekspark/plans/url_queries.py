"""URL and page functions over the pages table, with spelled-out cases beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekspark.functions import fetching, html, phrases, urls
from seekspark.plans.registry import Registry, names, values
from seekspark.sources.tables import table

REGISTRY = Registry()
CASES = [
    "https://Example.COM:443/p#section", "https://shop.example/p?utm_source=news&id=7&utm_medium=email", "https://a.example/s?q=a+b,c&x=1", "http://a.example:80",
    "http://a.example:8080/x?", "ftp://a.example/f", "no url", "https://www.example.co.uk/page", "https://blog.example.ac.uk/en-us/intl/a/b/c/d", "https://a.example/privacy-policy.html",
    "https://a.example/search/results?query=x", "https://a.example/x?KEYWORD=1;s=2", "https://a.example/f/photo.JPG", "https://a.example/sitemap.xml.gz", "https://a.example/.htaccess",
    "https://a.example/blog/why-policies-matter", "https://localhost/terms_of_use/", "https://a.example/?fbclid=1", "https://a.example/p?ref_=nav&ref=keep&mc_x=1", "https://h.example?x=1", "https://h.example#f",
]
_ROWS = values([(-i, u) for i, u in enumerate(CASES, 1)], "page_id, url")
U = f"(SELECT page_id, url FROM pages UNION ALL SELECT * FROM {_ROWS})"
_RE = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
PARTS = f"""(SELECT page_id, url, lower(regexp_extract(url, '{_RE}', 1)) AS s, CASE WHEN lower(regexp_extract(url, '{_RE}', 1)) = 'http' THEN regexp_replace(lower(regexp_extract(url, '{_RE}', 2)), ':(80)?$', '')
    ELSE regexp_replace(lower(regexp_extract(url, '{_RE}', 2)), ':(443)?$', '') END AS a, lower(regexp_extract(url, '{_RE}', 2)) AS netloc,
    CASE WHEN regexp_extract(url, '{_RE}', 3) = '' THEN '/' ELSE regexp_extract(url, '{_RE}', 3) END AS p, coalesce(regexp_extract(url, '{_RE}', 4), '') AS q FROM {U})"""
_TRACKING = f"(lower(split_part(x, '=', 1)) IN ({names(urls.TRACKING_NAMES)}) OR regexp_matches(lower(split_part(x, '=', 1)), '{urls.TRACKING_PREFIX}'))"
_PAIRS = "list_filter(string_split(substr(q, 2), '&'), lambda x: x <> '')"
CANONICAL = f"""(SELECT page_id, url, CASE WHEN s IN ('http', 'https') AND a <> '' THEN s || '://' || a || p || CASE WHEN len(kept) = len(pairs) THEN q WHEN len(kept) = 0 THEN ''
    ELSE '?' || array_to_string(list_transform(kept, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') END END AS canonical
    FROM (SELECT *, {_PAIRS} AS pairs, list_filter({_PAIRS}, lambda x: NOT {_TRACKING}) AS kept FROM {PARTS}))"""
RANK_HOST = "lower(split_part(split_part(regexp_replace(url, '^.*?://', ''), '/', 1), '?', 1))"
_BARE = "split_part(split_part(regexp_replace(url, '^.*?://', ''), '?', 1), '#', 1)"
SEGMENTS = f"list_filter(string_split(lower(CASE WHEN contains({_BARE}, '/') THEN regexp_replace({_BARE}, '^[^/]*/', '') ELSE '' END), '/'), lambda x: x <> '')"
_PARAMS = r"list_filter(list_transform(regexp_split_to_array(regexp_extract(url, '\?(.*)$', 1), '[&;]'), lambda x: lower(trim(split_part(x, '=', 1)))), lambda x: x <> '')"
_NAME = rf"list_filter(string_split(regexp_replace(regexp_replace({RANK_HOST}, ':.*$', ''), '^www\.', ''), '.'), lambda x: x <> '')"
LABEL = f"CASE WHEN len({_NAME}) >= 3 AND {_NAME}[-2] IN ({names(urls.SECOND_LEVEL)}) THEN {_NAME}[-3] WHEN len({_NAME}) >= 2 THEN {_NAME}[-2] ELSE coalesce({_NAME}[1], '') END"
_STEM = r"regexp_replace(x, '\.[^.]*$', '')"
LEGAL = f"len(list_filter({SEGMENTS}, lambda x: list_filter(regexp_split_to_array({_STEM}, '[-_]'), lambda y: y <> '')[1] IN ({names(urls.LEGAL)}))) > 0"
SEARCH = f"(len(list_filter({SEGMENTS}, lambda x: {_STEM} IN ({names(urls.SEARCH_SEGMENTS)}))) > 0 OR len(list_filter({_PARAMS}, lambda x: x IN ({names(urls.SEARCH_PARAMS)}))) > 0)"
QUALITY = f"""((CASE WHEN {LEGAL} THEN 0.3::DOUBLE ELSE 1 END) * (CASE WHEN len(list_filter({SEGMENTS}, lambda x: x = 'intl' OR regexp_matches(x, '^[a-z]{{2}}[-_][a-z0-9]{{2,4}}$'))) > 0 THEN 0.55::DOUBLE ELSE 1 END)
    * (CASE WHEN {SEARCH} THEN 0.3::DOUBLE ELSE 1 END) * (CASE WHEN len({SEGMENTS}) = 0 THEN 1.15::DOUBLE WHEN len({SEGMENTS}) > 2 THEN greatest(0.55::DOUBLE, pow(0.93::DOUBLE, len({SEGMENTS}) - 2)) ELSE 1 END))"""
TITLE = r"regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)"


def all_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").union(spark.sql(f"SELECT CAST(page_id AS BIGINT), url FROM {_ROWS}"))


def _url():
    return F.col("url")


@REGISTRY.query(f"SELECT page_id, canonical FROM {CANONICAL}")
def q_canonical_url(spark, sf_dir):
    return all_urls(spark, sf_dir).select("page_id", urls.canonical_url(_url()).alias("canonical"))


@REGISTRY.query(f"SELECT page_id, unnest({_PAIRS}) AS pair, unnest(list_transform({_PAIRS}, lambda x: {_TRACKING})) AS tracking FROM {PARTS}")
def q_tracking_params(spark, sf_dir):
    pairs = F.filter(F.split(urls.query(_url()), "&"), lambda p: p != "")
    return all_urls(spark, sf_dir).select("page_id", F.explode(pairs).alias("pair")).withColumn("tracking", urls.is_tracking_param(F.substring_index("pair", "=", 1)))


@REGISTRY.query(f"""SELECT page_id, CASE WHEN s IN ('http', 'https') AND netloc <> '' AND NOT regexp_matches(lower(p), '\\.({"|".join(sorted(urls.SEED_ASSETS))})$') THEN s || '://' || netloc || p || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS seed
    FROM (SELECT *, list_filter({_PAIRS}, lambda x: NOT regexp_matches(split_part(x, '=', 1), '{urls.SEED_TRACKING}')) AS kept FROM {PARTS})""")
def q_seed_canonical(spark, sf_dir):
    return all_urls(spark, sf_dir).select("page_id", urls.canonical_seed(_url()).alias("seed"))


@REGISTRY.query(f"""SELECT page_id, nullif(regexp_replace(a, ':[0-9]*$', ''), '') AS crawl_host, nullif(lower(regexp_extract(url, '://([^/?#]*)', 1)), '') AS graph_host, {RANK_HOST} AS rank_host FROM {PARTS}""")
def q_host_variants(spark, sf_dir):
    return all_urls(spark, sf_dir).select("page_id", urls.crawl_host(_url()).alias("crawl_host"), urls.graph_host(_url()).alias("graph_host"), urls.rank_host(_url()).alias("rank_host"))


@REGISTRY.query(f"SELECT page_id, {LABEL} AS label FROM {U}")
def q_host_label(spark, sf_dir):
    return all_urls(spark, sf_dir).select("page_id", urls.host_label(_url()).alias("label"))


@REGISTRY.query(f"SELECT page_id, len({SEGMENTS})::BIGINT AS n, array_to_string({SEGMENTS}, '/') AS segments, array_to_string({_PARAMS}, '&') AS params FROM {U}")
def q_path_segments(spark, sf_dir):
    return all_urls(spark, sf_dir).select("page_id", F.size(urls.path_segments(_url())).alias("n"), F.array_join(urls.path_segments(_url()), "/").alias("segments"), F.array_join(urls.query_param_names(_url()), "&").alias("params"))


_LAST = r"regexp_replace(lower(string_split(p, '/')[-1]), '\.gz$', '')"


@REGISTRY.query(f"SELECT page_id, s <> '' AND regexp_extract({_LAST}, '^.+\\.([^.]*)$', 1) NOT IN ({names(urls.NOT_PAGES)}) AS page, s <> '' AND regexp_matches(lower(p), '\\.xml(\\.gz)?$') AS sitemap FROM {PARTS}")
def q_is_page(spark, sf_dir):
    return all_urls(spark, sf_dir).select("page_id", urls.is_probably_page(_url()).alias("page"), urls.is_sitemap_url(_url()).alias("sitemap"))


@REGISTRY.query(f"SELECT page_id, {SEARCH} AS search_view, {LEGAL} AS legal FROM {U}")
def q_search_view_legal(spark, sf_dir):
    return all_urls(spark, sf_dir).select("page_id", urls.is_search_view(_url()).alias("search_view"), urls.is_legal(_url()).alias("legal"))


@REGISTRY.query(f"SELECT page_id, round({QUALITY}, 6) AS quality FROM {U}")
def q_url_quality(spark, sf_dir):
    return all_urls(spark, sf_dir).select("page_id", F.round(urls.url_quality(_url()), 6).alias("quality"))


@REGISTRY.query(f"SELECT page_id, p || q AS request_path, CASE WHEN s IN ('http', 'https') AND a <> '' THEN s || '://' || a || '/robots.txt' END AS robots FROM {PARTS}")
def q_request_path(spark, sf_dir):
    return all_urls(spark, sf_dir).select("page_id", urls.request_path(_url()).alias("request_path"), urls.robots_url(_url()).alias("robots"))


_VISIBLE = "regexp_replace(regexp_extract(html, '(?is)<body>(.*?)(?:</body>|\\z)', 1), '(?is)<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->|<[^>]*>', ' ', 'g')"
_PLAIN = f"replace(replace(replace(replace({TITLE}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


TITLE_TEXT = f"trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g'))"


@REGISTRY.query(f"SELECT page_id, {TITLE_TEXT} AS title FROM pages")
def q_title_extract(spark, sf_dir):
    """Titles by the HTML reader; the twin's expression covers the references that occur in the sample pages."""
    return table(spark, sf_dir, "pages").select("page_id", html.extract_page("html", "url")["title"].alias("title"))


_TOKENS = f"regexp_extract_all(lower({TITLE}), '[a-z0-9]+')"


@REGISTRY.query(f"SELECT page_id, round(CASE WHEN len({_TOKENS}) = 0 THEN 0 ELSE least(1, len(list_intersect(list_distinct({_TOKENS}), ['the', 'and'])) / len({_TOKENS})) END, 6) AS match FROM pages")
def q_title_match(spark, sf_dir):
    from seekspark.functions.text import title_match

    return table(spark, sf_dir, "pages").select("page_id", F.round(title_match(html.raw_title(F.col("html")), ["the", "and", "the"]), 6).alias("match"))


_HREFS = "regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)"
_ENCODED = "array_to_string(list_transform(string_split(x, ''), lambda c: CASE WHEN regexp_matches(c, '^[!-~]$') THEN c ELSE url_encode(c) END), '')"


@REGISTRY.query(f"SELECT DISTINCT page_id, unnest(list_transform({_HREFS}, lambda x: s || '://' || a || {_ENCODED})) AS link FROM (SELECT page_id, html FROM pages) JOIN {PARTS} USING (page_id)")
def q_links_resolved(spark, sf_dir):
    """Where the links of each page lead; the twin covers root-relative links, which all of the sample are."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(html.extract_page("html", "url")["links"]).alias("link"))


@REGISTRY.query(f"SELECT page_id, count(DISTINCT link)::BIGINT AS outdegree FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY page_id")
def q_outdegree(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(html.extract_page("html", "url")["links"]).alias("outdegree")).filter("outdegree > 0")


#: What readers see of a page: the twin knows the furniture and the references that occur in the sample pages.
BODY_TEXT = f"trim(regexp_replace({_PLAIN.replace(TITLE, _VISIBLE)}, '\\s+', ' ', 'g'))"


@REGISTRY.query(f"SELECT page_id, {BODY_TEXT} AS body, NULL::VARCHAR AS description FROM pages")
def q_html_body_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.extract_page("html", "url").alias("p")).select("page_id", F.col("p.text").alias("body"), F.col("p.description").alias("description"))


@REGISTRY.query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed FROM documents")
def q_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", html.collapse_whitespace(F.col("text")).alias("collapsed"))


@REGISTRY.query("SELECT count(*)::BIGINT AS rows, count(DISTINCT text)::BIGINT AS contents, max(n)::BIGINT AS largest FROM (SELECT text, count(*) OVER (PARTITION BY text) AS n FROM documents)")
def q_content_dup_groups(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy(fetching.content_hash("text").alias("h")).count()
    return groups.agg(F.sum("count").alias("rows"), F.count("*").alias("contents"), F.max("count").alias("largest"))


@REGISTRY.query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
def q_iso8601(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fetching.iso8601(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("at"))


@REGISTRY.query(None)
def q_record_id(spark, sf_dir):
    from seekspark.plans.registry import fetched_at

    return table(spark, sf_dir, "pages").select("page_id", fetching.record_id("url", fetched_at()).alias("record_id"))


_LISTED = "'<urlset><url><LOC>' || replace(url, '&', '&amp;') || '</LOC></url><url><loc> <![CDATA[https://c.example/' || page_id || ']]> </loc></url><loc>ftp://f.example/</loc><loc>https://a.example/&#228;&eacute;&quot;</loc><loc>' || url"


@REGISTRY.query("SELECT page_id, url || '|https://c.example/' || page_id || '|https://a.example/äé\"' AS urls, page_id % 4 = 0 AS is_index FROM pages")
def q_sitemap_urls(spark, sf_dir):
    """A sitemap for each page: CDATA, references by name and number, another scheme, and a record that isn't closed."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_LISTED).alias("body"))
    index = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<SitemapIndex>"), "body")).otherwise(F.col("body"))
    return rows.select("page_id", F.array_join(html.sitemap_urls(F.col("body")), "|").alias("urls"), html.is_sitemap_index(index).alias("is_index"))


_KINDS = ('text/html; charset="UTF-8"', "application/xml", "application/xhtml+xml;charset=iso-8859-1", "image/png", "TEXT/HTML; Charset='utf-8' ; x=1", "", None)
_KIND = "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '" + k.replace("'", "''") + "'" for i, k in enumerate(_KINDS) if k is not None) + " END"


@REGISTRY.query(f"""SELECT page_id, nullif(lower(trim(regexp_extract(kind, '(?i)charset=([^; \t]*)', 1), '"''')), '') AS charset, coalesce(contains(lower(kind), 'html') OR contains(lower(kind), 'xml'), true) AS html,
    coalesce(contains(lower(kind), 'xml') AND NOT contains(lower(kind), 'html'), false) AS xml FROM (SELECT page_id, {_KIND} AS kind FROM pages)""")
def q_charset(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.col("page_id") % 7)
    return table(spark, sf_dir, "pages").select("page_id", fetching.charset_of(kind).alias("charset"), urls.is_html_content_type(kind).alias("html"), urls.is_xml_content_type(kind).alias("xml"))


@REGISTRY.query("SELECT event_id, least(250 * pow(2, least(event_id % 70, 63)), 30000)::BIGINT AS backoff_ms, status = 429 OR status BETWEEN 500 AND 599 AS retry FROM (SELECT event_id, 400 + event_id % 230 AS status FROM events)")
def q_backoff(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", fetching.backoff_ms(i % 70).alias("backoff_ms"), fetching.is_retryable_status(400 + i % 230).alias("retry"))


_AFTER = "[page_id::VARCHAR, ' ' || page_id || ' ', 'Wed, 21 Oct 2015 07:28:00 GMT', '-' || page_id, '', NULL, '9223372036854775807', '+7'][1 + page_id % 8]"


@REGISTRY.query(f"SELECT page_id, CASE WHEN regexp_matches(trim(header), '^[+]?[0-9]+$') THEN least(CAST(regexp_replace(trim(header), '^[+]', '') AS HUGEINT) * 1000, 9223372036854775807)::BIGINT END AS ms FROM (SELECT page_id, {_AFTER} AS header FROM pages)")
def q_retry_after(spark, sf_dir):
    i = F.col("page_id").cast("string")
    header = F.get(F.array(i, F.concat(F.lit(" "), i, F.lit(" ")), F.lit("Wed, 21 Oct 2015 07:28:00 GMT"), F.concat(F.lit("-"), i), F.lit(""), F.lit(None), F.lit("9223372036854775807"), F.lit("+7")), F.col("page_id") % 8)
    return table(spark, sf_dir, "pages").select("page_id", fetching.parse_retry_after(header).alias("ms"))


@REGISTRY.query("SELECT page_id, greatest(1000, coalesce(CASE WHEN page_id % 3 > 0 THEN page_id % 9 END * 1000, 0))::BIGINT AS ms FROM pages")
def q_politeness(spark, sf_dir):
    delay = F.when(F.col("page_id") % 3 > 0, F.col("page_id") % 9)
    return table(spark, sf_dir, "pages").select("page_id", fetching.politeness_delay_ms(delay).alias("ms"))


_HOURS = "printf('%.1f', s / 3600) || ' h'"


@REGISTRY.query(f"""SELECT event_id, strftime(make_timestamp(event_id * 86399 * 1000000), '%d %b %Y, %H:%M UTC') AS date, strftime(make_timestamp(event_id * 86399 * 1000000), '%H:%M') AS clock,
    CASE WHEN event_id % 11 = 0 THEN 'never' WHEN s < 5 THEN 'just now' WHEN s < 60 THEN s || ' s ago' WHEN s < 3600 THEN s // 60 || ' min ago' ELSE {_HOURS} || ' ago' END AS age,
    replace(format('{{:,}}', event_id * 12347), ',', chr(8201)) AS count,
    CASE WHEN event_id % 13 = 0 THEN 'no index reading yet' WHEN event_id % 5 = 0 THEN 'indexer idle' WHEN event_id % 11 <> 0 AND s > 60 THEN 'quiet ' || CASE WHEN s < 3600 THEN s // 60 || ' min' ELSE {_HOURS} END || ' · ' || replace(format('{{:,}}', event_id % 3000), ',', ' ') || '/min avg'
    WHEN event_id % 3000 = 0 THEN 'indexer running' ELSE 'indexing ' || replace(format('{{:,}}', event_id % 3000), ',', ' ') || '/min' END AS state, event_id % 13 <> 0 AND event_id % 5 <> 0 AND (event_id % 11 = 0 OR s <= 60) AS live
    FROM (SELECT event_id, event_id * 7919 % 20000 - 40 AS s FROM events) WHERE s % 180 <> 0 OR s < 3600""")
def q_phrases(spark, sf_dir):
    """Dates, ages, counts and the indexer's state in words. Ages halfway between two tenths of an hour are left out of the comparison: engines round them apart."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", (i * 7919 % 20000 - 40).alias("s")).filter("s % 180 <> 0 OR s < 3600")
    age = F.when(i % 11 != 0, F.col("s"))
    there, idle, rate = i % 13 != 0, i % 5 == 0, (i % 3000).cast("double")
    return rows.select(
        "event_id", phrases.format_date(i * 86399).alias("date"), phrases.format_clock(i * 86399).alias("clock"), phrases.format_age(age).alias("age"), phrases.format_count(i * 12347).alias("count"),
        phrases.growth_state(there, idle, rate, age).alias("state"), phrases.growth_is_live(there, idle, age).alias("live"),
    )


@REGISTRY.query("SELECT event_id, greatest(1700000000 - seen, 0)::DOUBLE AS age_s, coalesce(greatest(1700000000 - seen, 0) > 10, true) AS stale FROM (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN 1700000000 - event_id % 25 + 3 END::DOUBLE AS seen FROM events)")
def q_crawl_age(spark, sf_dir):
    from seekspark.operators import analytics

    seen = F.when(F.col("event_id") % 7 > 0, 1700000000 - F.col("event_id") % 25 + 3).cast("double")
    return table(spark, sf_dir, "events").select("event_id", analytics.crawl_age(seen, 1700000000.0).alias("a")).select("event_id", "a.age_s", "a.stale")


@REGISTRY.query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, NULL::VARCHAR AS missing FROM events")
def q_known_fields(spark, sf_dir):
    """Records cut down to the fields that are known; one of them none has."""
    from seekspark.sources.tables import known_fields

    return table(spark, sf_dir, "events").select("event_id", known_fields(F.col("props"), "k long, missing string").alias("r")).select("event_id", "r.*")
