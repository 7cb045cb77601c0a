"""Link graph, frontier, robots, seeds and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekspark.functions import fetching, html, robots, urls
from seekspark.operators import analytics, engine, frontier, graph
from seekspark.plans.registry import EDGES_SQL, Registry, gzipped, names, page_edges, values
from seekspark.plans.url_queries import CANONICAL
from seekspark.sources.tables import table

REGISTRY = Registry()
_HOST = lambda c: f"lower(regexp_extract({c}, '://([^/?#]*)', 1))"
_INLINKS = f"(SELECT {_HOST('dst')} AS host, count(*)::BIGINT AS inlinks FROM {EDGES_SQL} WHERE {_HOST('src')} <> {_HOST('dst')} GROUP BY 1)"


def _pagerank_sql(iterations: int = 20) -> str:
    parts = [
        f"e AS MATERIALIZED (SELECT * FROM {EDGES_SQL})", "nodes AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e)", "deg AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY src)",
        "c AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes)", "r0 AS MATERIALIZED (SELECT node, 1 / n AS rank FROM nodes, c)",
    ]
    for i in range(1, iterations + 1):
        parts.append(f"""r{i} AS MATERIALIZED (SELECT node, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(passed, 0) + loose / n) AS rank FROM nodes CROSS JOIN c
            CROSS JOIN (SELECT coalesce(sum(rank), 0) AS loose FROM r{i - 1} WHERE node NOT IN (SELECT src FROM deg))
            LEFT JOIN (SELECT dst, sum(rank / d) AS passed FROM e JOIN deg USING (src) JOIN r{i - 1} ON node = src GROUP BY dst) ON dst = node)""")
    return "WITH " + ", ".join(parts)


@REGISTRY.query(f"SELECT * FROM {EDGES_SQL}")
def q_link_edges(spark, sf_dir):
    pages = page_edges(table(spark, sf_dir, "pages")).groupBy("src").agg(F.collect_list("dst").alias("links"))
    return graph.link_edges(pages, "src", "links")


@REGISTRY.query(f"SELECT * FROM {_INLINKS}")
def q_host_inlinks(spark, sf_dir):
    return graph.host_inlinks(page_edges(table(spark, sf_dir, "pages")))


@REGISTRY.query(f"SELECT host, (2 * inlinks)::BIGINT AS inlinks, round(1 - exp(-2 * inlinks / 8.0), 6) AS host_authority FROM {_INLINKS}")
def q_host_authority(spark, sf_dir):
    """Of a second run over the same pages, whose links add to the totals kept."""
    edges = page_edges(table(spark, sf_dir, "pages"))
    return graph.host_authority(graph.host_inlinks(edges, graph.host_inlinks(edges))).withColumn("host_authority", F.round("host_authority", 6))


@REGISTRY.query(_pagerank_sql() + " SELECT node, round(rank, 9) AS rank FROM r20")
def q_pagerank(spark, sf_dir):
    return graph.pagerank(page_edges(table(spark, sf_dir, "pages"))).withColumn("rank", F.round("rank", 9))


@REGISTRY.query(_pagerank_sql() + " SELECT node, round(rank, 9) AS rank FROM r20")
def q_pagerank_joined(spark, sf_dir):
    """The iterations as joins, as for graphs that no one task should hold."""
    return graph.pagerank(page_edges(table(spark, sf_dir, "pages")), distributed=True).withColumn("rank", F.round("rank", 9))


@REGISTRY.query(_pagerank_sql() + f""" SELECT node AS url, round(1 - exp(-rank * n / 4), 6) AS authority, round(coalesce(1 - exp(-inlinks / 8.0), 0), 6) AS host_authority
    FROM r20 CROSS JOIN c LEFT JOIN {_INLINKS} ON host = {_HOST('node')}""")
def q_authority(spark, sf_dir):
    out = graph.authority(page_edges(table(spark, sf_dir, "pages")))
    return out.select("url", F.round("authority", 6).alias("authority"), F.round("host_authority", 6).alias("host_authority"))


@REGISTRY.query(f"SELECT (SELECT count(*) FROM (SELECT src FROM {EDGES_SQL} UNION SELECT dst FROM {EDGES_SQL}))::BIGINT AS nodes, count(*)::BIGINT AS edges, false AS over_limit FROM {EDGES_SQL}")
def q_graph_shape(spark, sf_dir):
    return graph.shape(page_edges(table(spark, sf_dir, "pages")))


@REGISTRY.query(f"SELECT p.page_id, round(coalesce(n / 10.0, 0), 6) AS score FROM pages p LEFT JOIN (SELECT dst, count(*) AS n FROM {EDGES_SQL} GROUP BY dst) ON dst = url")
def q_scores_join(spark, sf_dir):
    """Documents with the scores they have, 0 for those without."""
    scores = page_edges(table(spark, sf_dir, "pages")).groupBy(F.col("dst").alias("url")).agg((F.count("*") / 10.0).alias("authority"))
    scored = graph.with_scores(table(spark, sf_dir, "pages").select("page_id", "url"), scores.withColumn("host_authority", F.lit(0.0)))
    return scored.select("page_id", F.round("authority", 6).alias("score"))


@REGISTRY.query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def q_upsert_latest(spark, sf_dir):
    """An index of the first half of the updates, then the second half upserted: of each key the last update is left."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    half = events.agg(F.max("event_id")).first()[0] // 2
    old, new = (engine.latest(events.filter(x), "user_id", "event_id") for x in (F.col("event_id") <= half, F.col("event_id") > half))
    return engine.upsert(old, new, "user_id")


_SEEN = "(SELECT page_id, canonical AS url FROM {c} WHERE page_id >= 0)".format(c=CANONICAL)


@REGISTRY.query(f"SELECT url FROM {_SEEN} WHERE NOT starts_with(url, 'http://')")
def q_seen_anti(spark, sf_dir):
    """Pages that weren't seen, where all of plain http were."""
    known = table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))
    return frontier.unseen(known, known.filter(F.col("url").startswith("http://"))).select("url")


_WEB_HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':[0-9]*$', '')"


@REGISTRY.query(f"SELECT page_id FROM pages WHERE {_WEB_HOST} IN (SELECT {_WEB_HOST} FROM pages WHERE starts_with(url, 'https://'))")
def q_scope_semi(spark, sf_dir):
    """Pages of the hosts that have a page on https."""
    pages = table(spark, sf_dir, "pages").withColumn("host", urls.crawl_host(F.col("url")))
    return frontier.in_scope(pages, pages.filter(F.col("url").startswith("https://"))).select("page_id")


@REGISTRY.query(f"SELECT url, min(page_id)::BIGINT AS seq, 1::BIGINT AS depth FROM {_SEEN} WHERE ends_with({_WEB_HOST}, '.org') AND NOT starts_with(url, 'http://') GROUP BY url")
def q_schedule(spark, sf_dir):
    """All pages as links, twice; the scope is the hosts under .org, and plain http was seen."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("url", F.lit(0).alias("depth"), F.col("page_id").alias("seq"))
    seen = pages.filter(F.col("url").startswith("http://")).select(urls.canonical_url(F.col("url")).alias("url"))
    scope = pages.select(urls.crawl_host(F.col("url")).alias("host")).filter(F.col("host").endswith(".org"))
    return frontier.schedule(links.unionAll(links), seen, scope).select("url", "seq", "depth")


def _frontier(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(urls.crawl_host(F.col("url")).alias("host"), F.col("page_id").alias("seq"))


_FRONTIER = f"(SELECT page_id AS seq, {_WEB_HOST} AS host FROM pages)"


@REGISTRY.query(f"SELECT host, min(seq)::BIGINT AS seq FROM {_FRONTIER} GROUP BY host")
def q_frontier_heads(spark, sf_dir):
    return frontier.heads(_frontier(spark, sf_dir))


@REGISTRY.query(f"SELECT host, min(seq)::BIGINT AS seq FROM {_FRONTIER} GROUP BY host HAVING coalesce(CASE WHEN length(host) % 2 = 0 THEN length(host) * 100 END, 0) <= 1600 ORDER BY host LIMIT 32")
def q_pop_ready(spark, sf_dir):
    jobs = _frontier(spark, sf_dir)
    hosts = jobs.select("host").distinct().filter("length(host) % 2 = 0").withColumn("next_allowed_at_ms", F.length("host") * 100)
    return frontier.pop_ready(jobs, hosts, 1600)


@REGISTRY.query(f"SELECT host, seq FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS n FROM {_FRONTIER}) WHERE n <= 2 ORDER BY n, seq LIMIT 32")
def q_inflight_assign(spark, sf_dir):
    return frontier.assign(_frontier(spark, sf_dir))


@REGISTRY.query(f"SELECT host, (5000 + greatest(1000, max(seq % 4) * 1000))::BIGINT AS next_allowed_at_ms, 5000::BIGINT AS last_fetched_at_ms FROM {_FRONTIER} GROUP BY host")
def q_defer_hosts(spark, sf_dir):
    jobs = _frontier(spark, sf_dir)
    hosts = jobs.select("host", F.lit(1).cast("long").alias("next_allowed_at_ms"), F.lit(1).cast("long").alias("last_fetched_at_ms")).distinct()
    return frontier.defer(hosts, jobs.select("host", (F.col("seq") % 4).alias("crawl_delay_s")), 5000)


@REGISTRY.query(f"SELECT seq, host, length(host) % 3 <> 0 AND 100 <= length(host) * 6 AS known FROM {_FRONTIER}")
def q_robots_ttl_join(spark, sf_dir):
    jobs = _frontier(spark, sf_dir)
    cache = jobs.select("host").distinct().filter("length(host) % 3 <> 0").select("host", F.lit(0).alias("fetched_at_ms"), (F.length("host") * 6).alias("ttl_ms"))
    return frontier.valid_robots(jobs, cache, 100).select("seq", "host", "known")


_RULES = [("a", "/x", False), ("a", "/x/y", True), ("b", "/*.html", False), ("b", "/en", True), ("c", "/en/7$", False), ("c", "/", True), ("d", "/en", True), ("d", "/en", False)]
_REGEX = {"/x": "^/x", "/x/y": "^/x/y", "/*.html": r"^/.*\.html", "/en": "^/en", "/en/7$": "^/en/7$", "/": "^/"}
_RULES_SQL = values([(h, len(p.rstrip("$")), _REGEX[p], a) for h, p, a in _RULES], "host, n, re, is_allow")
_PATHS = "(SELECT page_id, substr('abcde', 1 + (page_id % 5)::INT, 1) AS host, CASE WHEN page_id % 7 = 0 THEN '/x/y/' ELSE regexp_extract(url, '://[^/?#]*([^#]*)', 1) END AS path FROM pages)"


@REGISTRY.query(f"""SELECT page_id, coalesce(NOT arg_max(NOT is_allow, n * 2 + (NOT is_allow)::INT), true) AS allowed FROM (SELECT p.page_id, r.n, r.is_allow FROM {_PATHS} p LEFT JOIN {_RULES_SQL} r ON p.host = r.host AND regexp_matches(p.path, r.re)) GROUP BY page_id""")
def q_robots_allows(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select("page_id", F.substr(F.lit("abcde"), (F.col("page_id") % 5 + 1).cast("int"), F.lit(1)).alias("host"), F.when(F.col("page_id") % 7 == 0, "/x/y/").otherwise(urls.request_path(F.col("url"))).alias("path"))
    return robots.allowed(paths, spark.createDataFrame(_RULES, "host string, pattern string, is_allow boolean")).select("page_id", "allowed")


#: A robots.txt for each page: a group for all, and one for two agents, whose names and rules follow the page.
_ROBOTS = """'User-agent: *' || chr(10) || 'Disallow: /all/' || page_id || ' # not here' || chr(10) || 'Crawl-delay: ' || page_id % 7 || '.2' || chr(10) || chr(10) || 'user-agent: ' || CASE WHEN page_id % 2 = 0 THEN 'SEEK' ELSE 'other' END || chr(10)
    || 'User-agent: third' || chr(10) || 'ALLOW: /own/' || page_id || chr(10) || 'Disallow:' || chr(10) || 'Sitemap: https://x.example/' || page_id || '.xml'"""


@REGISTRY.query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '|/own/' || page_id || '|' ELSE '/all/' || page_id || '||' || (page_id % 7 + 1) END || '|https://x.example/' || page_id || '.xml' AS said FROM pages")
def q_robots_parse(spark, sf_dir):
    """The group that an agent gets: its own where there is one, else that for all; sitemaps hold for everyone."""
    rows = table(spark, sf_dir, "pages").select("page_id", robots.parse_robots(F.expr(_ROBOTS), "Seekbot/1.0").alias("r"))
    joined = lambda c: F.array_join(f"r.{c}", ",")
    return rows.select("page_id", F.concat_ws("|", joined("disallow"), joined("allow"), F.coalesce(F.col("r.crawl_delay_s").cast("string"), F.lit("")), joined("sitemaps")).alias("said"))


_INTERLEAVED = f"""(WITH s AS (SELECT page_id AS seq, {_WEB_HOST} AS site, substr(url, 1, length(url) - page_id::INT % 2) AS url FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq) - 1 AS depth, min(seq) OVER (PARTITION BY site) AS ss FROM s),
    c AS (SELECT count(DISTINCT site) AS n FROM s), f AS (SELECT url, min(struct_pack(late := depth >= greatest(8, ceil(40 / n)), depth := depth, ss := ss, site := site)) AS k FROM r, c GROUP BY url)
    SELECT row_number() OVER (ORDER BY k) AS place, url, k.site AS site FROM f ORDER BY k LIMIT 40)"""


def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.expr("substr(url, 1, length(url) - page_id % 2)").alias("url"), urls.crawl_host(F.col("url")).alias("site"), F.col("page_id").alias("seq"))


@REGISTRY.query(f"SELECT * FROM {_INTERLEAVED}")
def q_interleave(spark, sf_dir):
    return frontier.interleave(_seeds(spark, sf_dir), 40)


@REGISTRY.query(f"SELECT place, ntile(6) OVER (ORDER BY place) AS slice FROM {_INTERLEAVED}")
def q_seed_slices(spark, sf_dir):
    return frontier.slices(frontier.interleave(_seeds(spark, sf_dir), 40)).select("place", "slice")


_OUTCOMES = """(SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'page' WHEN 1 THEN 'sitemap' WHEN 2 THEN 'disallowed' WHEN 3 THEN 'failed' ELSE 'link' END AS kind, page_id % 4 = 0 AS off_site, contains(url, '.html') AS asset, page_id % 5 <> 0 AS fresh,
    page_id % 6 < 2 AND page_id % 7 = 0 AS redirected, page_id % 6 < 2 AND page_id % 21 = 0 AS dropped FROM pages)"""


@REGISTRY.query(f"""SELECT count(*) FILTER (kind = 'link' AND NOT off_site AND NOT asset AND fresh)::BIGINT AS queued, count(*) FILTER (kind = 'page' AND NOT dropped)::BIGINT AS fetched, count(*) FILTER (kind = 'page' AND NOT dropped)::BIGINT AS indexed,
    count(*) FILTER (kind = 'failed')::BIGINT AS failed, count(*) FILTER (kind = 'disallowed')::BIGINT AS disallowed, count(*) FILTER (kind = 'sitemap' AND NOT dropped)::BIGINT AS sitemaps, count(*) FILTER (kind = 'link' AND off_site)::BIGINT AS skipped_offsite,
    count(*) FILTER (kind = 'link' AND NOT off_site AND asset)::BIGINT AS skipped_assets, count(*) FILTER (redirected)::BIGINT AS redirected_offsite FROM {_OUTCOMES}""")
def q_crawl_counters(spark, sf_dir):
    i = F.col("page_id")
    kind = F.when(i % 6 == 0, "page").when(i % 6 == 1, "sitemap").when(i % 6 == 2, "disallowed").when(i % 6 == 3, "failed").otherwise("link")
    visit = i % 6 < 2
    outcomes = table(spark, sf_dir, "pages").select(kind.alias("kind"), (i % 4 == 0).alias("off_site"), F.col("url").contains(".html").alias("asset"), (i % 5 != 0).alias("fresh"), (visit & (i % 7 == 0)).alias("redirected"), (visit & (i % 21 == 0)).alias("dropped"))
    return analytics.crawl_counters(outcomes)


_ASSET = f"regexp_extract(regexp_replace(lower(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^.*/', '')), '\\.gz$', ''), '^.+\\.([^.]*)$', 1) IN ({names(urls.NOT_PAGES)})"
_LINKS_TWICE = f"(SELECT url, {_WEB_HOST} AS host, {_ASSET} AS asset FROM (SELECT CASE WHEN page_id % 6 = 0 THEN regexp_replace(url, '[?#].*$', '') || '.png' ELSE url END AS url FROM {_SEEN}), range(2))"


@REGISTRY.query(f"""SELECT count(*) FILTER (NOT ends_with(host, '.org'))::BIGINT AS skipped_offsite, count(*) FILTER (ends_with(host, '.org') AND asset)::BIGINT AS skipped_assets,
    count(DISTINCT CASE WHEN ends_with(host, '.org') AND NOT asset AND NOT starts_with(url, 'http://') THEN url END)::BIGINT AS queued FROM {_LINKS_TWICE}""")
def q_schedule_counters(spark, sf_dir):
    """What scheduling all pages as links, twice, skips and queues; every sixth leads to a picture."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(urls.canonical_url(F.col("url")))).alias("url"))
    picture = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit(".png"))
    links = pages.select(F.when(F.col("page_id") % 6 == 0, picture).otherwise(F.col("url")).alias("url"), F.lit(0).alias("depth"), F.col("page_id").alias("seq"))
    scope = pages.select(urls.crawl_host(F.col("url")).alias("host")).filter(F.col("host").endswith(".org"))
    return frontier.schedule_counters(links.unionAll(links), links.filter(F.col("url").startswith("http://")), scope)


@REGISTRY.query(f"SELECT min(page_id)::BIGINT AS seq, url, 1::BIGINT AS depth FROM {_SEEN} GROUP BY url")
def q_sitemap_jobs(spark, sf_dir):
    """The pages as a sitemap lists them: one hop from the seeds."""
    found = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("seq"))
    return frontier.schedule(frontier.sitemap_jobs(found)).select("seq", "url", "depth")


_FINAL = _WEB_HOST.replace("(url,", "(final_url,")


@REGISTRY.query(f"""SELECT *, NOT ends_with({_FINAL}, '.org') AS redirected_offsite FROM (SELECT a.page_id, coalesce(b.url, a.url) AS final_url FROM {_SEEN} a LEFT JOIN {_SEEN} b ON b.page_id = a.page_id // 2 AND a.page_id % 3 = 0)""")
def q_redirects(spark, sf_dir):
    """Every third page is redirected to another; the scope is the hosts under .org."""
    pages = table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))
    aim = F.when(F.col("page_id") % 3 == 0, F.floor(F.col("page_id") / 2))
    visits = pages.withColumn("aim", aim).join(pages.select(F.col("page_id").alias("aim"), F.concat("url", F.lit("#top")).alias("final_url")), "aim", "left")
    scope = pages.select(urls.crawl_host(F.col("url")).alias("host")).filter(F.col("host").endswith(".org"))
    return frontier.after_redirects(visits, scope).select("page_id", "final_url", "redirected_offsite")


@REGISTRY.query(f"SELECT host, max(seq)::BIGINT AS next_allowed_at_ms FROM {_FRONTIER} GROUP BY host ORDER BY host LIMIT 20")
def q_host_snapshot(spark, sf_dir):
    return frontier.host_snapshot(_frontier(spark, sf_dir).groupBy("host").agg(F.max("seq").alias("next_allowed_at_ms")), 20)


@REGISTRY.query(f"SELECT count(DISTINCT host)::BIGINT AS n, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts FROM {_FRONTIER}")
def q_sorted_hosts(spark, sf_dir):
    return frontier.sorted_hosts(_frontier(spark, sf_dir)).select(F.size("hosts").alias("n"), F.array_join("hosts", ",").alias("hosts"))


_SITES = f"(SELECT host AS h, 'https://' || host AS site FROM (SELECT DISTINCT {_WEB_HOST} AS host FROM pages))"


@REGISTRY.query(f"""SELECT site, unnest([site || '/maps/a.xml', 'https://cdn.example/' || h || '.xml']) AS sitemap FROM {_SITES} WHERE length(h) % 3 <> 0
    UNION ALL SELECT site, site || CASE WHEN length(h) % 2 = 0 THEN '/sitemap.xml.gz' ELSE '/sitemap-index.xml' END FROM {_SITES} WHERE length(h) % 3 = 0 AND length(h) % 5 <> 0""")
def q_sitemap_discovery(spark, sf_dir):
    """Hosts whose robots.txt names sitemaps, relative and absolute, and others that have one in a usual place, or none."""
    host = _frontier(spark, sf_dir).select("host").distinct()
    rules = F.concat(F.lit("User-agent: *\nSITEMAP : /maps/a.xml \nSitemap: https://cdn.example/"), F.col("host"), F.lit(".xml"))
    sites = host.select(F.concat(F.lit("https://"), "host").alias("site"), F.when(F.length("host") % 3 == 0, "").otherwise(rules).alias("robots"))
    there = F.when(F.length("host") % 5 != 0, F.concat(F.lit("https://"), "host", F.when(F.length("host") % 2 == 0, "/sitemap.xml.gz").otherwise("/sitemap-index.xml")))
    later = F.when(there.isNotNull(), F.concat(F.lit("https://"), "host", F.lit("/sitemap-index.xml")))
    return robots.discover_sitemaps(sites, host.select(F.explode(F.array(there, later)).alias("url")).filter("url IS NOT NULL"))


@REGISTRY.query(f"SELECT host, unnest(u) AS loc FROM (SELECT {_WEB_HOST} AS host, list(url ORDER BY page_id) AS u FROM pages GROUP BY 1) WHERE length(host) % 4 <> 0")
def q_xml_locations(spark, sf_dir):
    """A sitemap of each host's pages, in a namespace, some as gzip, some broken: for the reader that wants whole XML."""
    line = F.concat(F.lit("<s:url><s:loc> "), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n</s:loc></s:url>"))
    rows = table(spark, sf_dir, "pages").select(urls.crawl_host(F.col("url")).alias("host"), "page_id", line.alias("line"))
    whole = rows.groupBy("host").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "line"))), lambda x: x["line"]), "").alias("lines"))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9">'), "lines", F.when(F.length("host") % 4 == 0, "</s:url>").otherwise("</s:urlset>"))
    body = F.when(F.length("host") % 3 == 0, gzipped(xml)).otherwise(xml.cast("binary"))
    return whole.select("host", F.explode(html.xml_locations(body)).alias("loc"))


@REGISTRY.query("SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN html END AS text FROM pages")
def q_decode_body(spark, sf_dir):
    """Pages as they come over the wire, gzip or plain, in the charset that their header names, read back."""
    i = F.col("page_id")
    latin = (i % 3 == 1) & ~F.col("html").rlike(r"[^\x00-\x7f\xa0-\xff]")
    wire = F.when(i % 7 == 0, None).when(latin, F.encode("html", "ISO-8859-1")).when(i % 2 == 0, gzipped(F.col("html"))).otherwise(F.encode("html", "UTF-8"))
    header = F.when(latin, "text/html; charset=ISO-8859-1").when(i % 4 == 0, "text/html").otherwise('text/html; charset="utf-8"')
    return table(spark, sf_dir, "pages").select("page_id", fetching.decode_body(wire, fetching.charset_of(header)).alias("text"))


@REGISTRY.query("SELECT page_id, CASE WHEN asked <= 30000 THEN greatest(asked, least(250 * pow(2, page_id % 12), 30000)::BIGINT + page_id % 250) END::BIGINT AS delay_ms FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 0 ELSE page_id % 60 * 1000 END AS asked FROM pages)")
def q_retry_decision(spark, sf_dir):
    """Tries of a page after a failure, some with a Retry-After; none is left where the server asks for more than the cap."""
    i = F.col("page_id")
    header = F.when(i % 3 != 0, (i % 60).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", fetching.retry_delay_ms(fetching.parse_retry_after(header), fetching.backoff_ms(i % 12), i % 250).alias("delay_ms"))


@REGISTRY.query(f"""SELECT page_id, regexp_replace({_HOST('url')}, '^www\\.', '') || CASE WHEN len(s) = 0 THEN '' ELSE ' › ' || array_to_string(list_transform(s[1:3], lambda x: url_decode(x)), ' › ') END AS crumbs
    FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages)""")
def q_breadcrumb(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.breadcrumb(F.col("url")).alias("crumbs"))


@REGISTRY.query(f"SELECT host, (3 * inlinks)::BIGINT AS inlinks FROM {_INLINKS}")
def q_drain_host_totals(spark, sf_dir):
    """Cross-site links kept over three batches, each of which runs twice and counts once."""
    from seekspark.streaming import drain

    edges = page_edges(table(spark, sf_dir, "pages"))
    return drain.host_totals_after([edges, edges, edges])


@REGISTRY.query("SELECT CASE WHEN kind = 'text/html' THEN 'page' WHEN kind = 'application/xml' OR regexp_matches(url, '\\.xml$') THEN 'sitemap' ELSE 'page' END AS class, count(*)::BIGINT AS n FROM (SELECT url, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/xml' END AS kind FROM pages) GROUP BY 1")
def q_classify(spark, sf_dir):
    kind = F.when(F.col("page_id") % 3 == 0, "text/html").when(F.col("page_id") % 3 == 1, "application/xml")
    return table(spark, sf_dir, "pages").groupBy(urls.classify(F.col("url"), kind).alias("class")).agg(F.count("*").alias("n"))


@REGISTRY.query("SELECT page_id, status, status = 404 AS allow_all, CASE WHEN status = 404 THEN 86400 ELSE 300 END::BIGINT AS ttl_s FROM (SELECT page_id, 400 + page_id % 120 AS status FROM pages)")
def q_robots_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", (400 + F.col("page_id") % 120).alias("status"))
    return rows.select("page_id", "status", robots.policy_when_missing(F.col("status")).alias("p")).select("page_id", "status", "p.*")


@REGISTRY.query("SELECT n, ceil(-n * ln(0.01) / (ln(2) * ln(2)))::BIGINT AS bits, greatest(1, round(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / n * ln(2)))::BIGINT AS hashes FROM (SELECT 1000 * (1 + o_orderkey % 1000) AS n FROM orders GROUP BY 1)")
def q_bloom_size(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((1000 * (1 + F.col("o_orderkey") % 1000)).alias("n")).distinct().collect()  # a thousand sizes
    return spark.createDataFrame([(r["n"], *frontier.bloom_size(r["n"], 0.01)[:2]) for r in rows], "n long, bits long, hashes long")


@REGISTRY.query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {EDGES_SQL}), r AS (SELECT url, 0 AS depth FROM pages WHERE regexp_matches(url, '://(www|blog)') UNION SELECT dst, depth + 1 FROM r JOIN e ON src = url WHERE depth < 3)
    SELECT c.canonical AS url, min(depth)::BIGINT AS depth FROM r JOIN {CANONICAL} c USING (url) GROUP BY 1""")
def q_crawl_levels(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    canonical = urls.canonical_url(F.col("url"))
    links = page_edges(pages).select(urls.canonical_url(F.col("src")).alias("url"), urls.canonical_url(F.col("dst")).alias("dst")).groupBy("url").agg(F.collect_list("dst").alias("links"))
    web = pages.select(canonical.alias("url")).join(links, "url", "left")
    return frontier.crawl(web, pages.filter(F.col("url").rlike("://(www|blog)")).select("url"))


@REGISTRY.query("SELECT event_id, user_id, event_type, (event_id // 1000)::BIGINT AS segment FROM events")
def q_spool(spark, sf_dir):
    """Events sealed as segments of a thousand and read back, each with its segment's number."""
    from seekspark.sources.tables import read_spool, write_spool
    from seekspark.streaming.folders import new_folder

    folder, events = new_folder(spark, "spool"), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    write_spool(events.withColumn("part", F.floor(F.col("event_id") / 1000)), f"{folder}/sealed", 500)
    return read_spool(spark, f"{folder}/sealed").filter("segment IS NOT NULL").select("event_id", "user_id", "event_type", F.col("part").alias("segment"))


@REGISTRY.query(f"SELECT row_number() OVER (ORDER BY page_id) - 3 + CASE WHEN page_id < 0 THEN 0 ELSE 0 END AS n, url FROM (SELECT -2 AS page_id, 'https://given.example/' AS url UNION ALL SELECT -1, 'https://given.example/' UNION ALL SELECT page_id, url FROM pages)")
def q_seed_file(spark, sf_dir):
    """A seed list written with notes, read behind two seeds given by hand; repeated ones stay."""
    from pyspark.sql.window import Window

    from seekspark.sources.tables import read_seeds, write_seeds
    from seekspark.streaming.folders import new_folder

    path = f"{new_folder(spark, 'seeds')}/list"
    write_seeds(table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("place")), path, ("seeds", "of all pages"))
    seeds = read_seeds(spark, path, ["https://given.example/"] * 2)
    return seeds.select((F.row_number().over(Window.orderBy("seq")) - 3).alias("n"), "url")  # a list that people read


@REGISTRY.query("SELECT max(event_id) + 1 AS next FROM events WHERE event_id % 3 > 0")
def q_next_sequence(spark, sf_dir):
    from seekspark.sources.tables import next_sequence

    names = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("seg-"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(".pdoc"))).otherwise("notes.txt").alias("name"))
    return next_sequence(names)


@REGISTRY.query(f"SELECT count(DISTINCT url)::BIGINT AS seen, count(DISTINCT url) FILTER (starts_with(url, 'http://'))::BIGINT AS plain FROM {_SEEN}")
def q_seen_set(spark, sf_dir):
    """The set of all URLs, kept and loaded again."""
    from seekspark.sources.tables import load_seen, save_seen
    from seekspark.streaming.folders import new_folder

    path, pages = new_folder(spark, "seen"), table(spark, sf_dir, "pages").select(urls.canonical_url(F.col("url")).alias("url"))
    save_seen(pages.unionAll(pages), path)
    return load_seen(spark, path).agg(F.count("*").alias("seen"), F.count_if(F.col("url").startswith("http://")).alias("plain"))


@REGISTRY.query("SELECT page_id, '<b>' || replace(replace(t, '&', '&amp;'), '\"', '&quot;') || '</b> &lt;i&gt; &amp;' AS snippet FROM (SELECT page_id, replace(replace(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1), '&quot;', '\"'), '&amp;', '&') AS t FROM pages)")
def q_safe_snippet(spark, sf_dir):
    """Titles, escaped or not, between the marks that stay, and an element that doesn't."""
    marked = F.concat(F.lit("<b>"), html.raw_title(F.col("html")), F.lit("</b> <i> &"))
    return table(spark, sf_dir, "pages").select("page_id", fetching.safe_snippet(marked).alias("snippet"))
