"""URLs as Column expressions: parts, canonical forms, hosts, and what a URL says about its page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING_NAMES = frozenset(
    "_ga _gl _openstat dclid ef_id fbclid gclid gclsrc gsc igshid mc_cid mc_eid msclkid primecampaignid s_kwcid scm spm twclid ucbcb ucpp vero_conv vero_id wickedid yclid".split()
)
TRACKING_PREFIX = r"^(_gac_|hsa_|mtm_|pd_rd_|pf_rd_|pk_|ref_|utm_)"
SEED_TRACKING = r"(?i)^(mc_|pd_rd_|pf_rd_|ref_|utm_|(_ga|fbclid|gclid|msclkid|primeCampaignId|ref|referrer|ucbcb|ucpp)$)"
NOT_PAGES = frozenset(
    """7z apk avi avif bin bmp bz2 css csv deb dmg doc docx eot eps exe flv gif heic ico iso jpeg jpg js m4a m4v map mjs mkv mov mp3 mp4
    odt ods oga ogg ogv otf pdf png ppt pptx ps rar rpm svg tar tif tiff tsv ttf wasm wav webm webp woff woff2 xls xlsx xz zip""".split()
)
SEED_ASSETS = frozenset(
    """7z apk atom avif bmp bz2 css deb dmg eot exe gif gz ico jpeg jpg js json mjs mp3 mp4 msi ogg pdf pkg png rar rpm rss svg tar tgz
    ttf txt wav webm webp whl woff woff2 xml xz zip""".split()
)
LEGAL = frozenset("accessibility cookie cookies disclaimer eula gdpr impressum imprint legal licence license licenses policies policy privacy terms trademark".split())
SEARCH_SEGMENTS = frozenset("search search-results searchresults suche suchergebnisse".split())
SEARCH_PARAMS = frozenset("keyword keywords q query s search search_term searchterm".split())
SECOND_LEVEL = frozenset("ac co com edu gov net org".split())

_WHOLE = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _group(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _WHOLE, n)


def scheme(url: Column) -> Column:
    """Lower-case scheme; empty where the URL can't be read."""
    return F.lower(_group(url, 1))


def path(url: Column) -> Column:
    """The path, ``/`` at least."""
    p = _group(url, 3)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    """The query without its question mark; empty where there is none."""
    return F.substr(_group(url, 4), F.lit(2))


def authority(url: Column) -> Column:
    """Lower-case host, with a port unless it is the scheme's own."""
    low = F.lower(_group(url, 2))
    own = F.when(scheme(url) == "http", F.regexp_replace(low, ":(80)?$", "")).otherwise(F.regexp_replace(low, ":(443)?$", ""))
    return own


def is_web(url: Column) -> Column:
    """An absolute http or https URL with a host."""
    return F.coalesce(scheme(url).isin("http", "https") & (authority(url) != ""), F.lit(False))


def is_tracking_param(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(*sorted(TRACKING_NAMES)) | low.rlike(TRACKING_PREFIX)


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def canonical_url(url: Column) -> Column:
    """One spelling for one page: no fragment, no tracking parameters, no default port, lower-case host. NULL unless http or https.

    The query stays byte for byte unless a parameter goes; what is left is then form-encoded anew. An emptied query loses its
    question mark, an empty one keeps it.
    """
    asked = query(url)
    pairs = F.filter(F.split(asked, "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~is_tracking_param(_decoded(F.substring_index(p, "=", 1))))

    def encoded(p: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        value = F.substr(p, F.length(name) + 2)
        return F.concat(F.url_encode(_decoded(name)), F.lit("="), F.url_encode(_decoded(value)))

    rest = F.when(F.size(kept) == F.size(pairs), _group(url, 4)).when(F.size(kept) == 0, "").otherwise(F.concat(F.lit("?"), F.array_join(F.transform(kept, encoded), "&")))
    return F.when(is_web(url), F.concat(scheme(url), F.lit("://"), authority(url), path(url), rest))


def canonical_seed(url: Column) -> Column:
    """The other canonical form, of seed lists: keeps ports, drops ``ref`` and ``mc_*`` too, takes no assets, re-encodes nothing."""
    netloc, p = F.lower(_group(url, 2)), path(url)
    kept = F.filter(F.split(query(url), "&"), lambda x: (x != "") & ~F.substring_index(x, "=", 1).rlike(SEED_TRACKING))
    asset = F.lower(p).rlike(r"\.(" + "|".join(sorted(SEED_ASSETS)) + ")$")
    asked = F.array_join(kept, "&")
    return F.when(scheme(url).isin("http", "https") & (netloc != "") & ~asset, F.concat(scheme(url), F.lit("://"), netloc, p, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def canonical_final_url(final: Column, asked: Column) -> Column:
    """The canonical target of a redirect, or the URL asked for if it has none."""
    return F.coalesce(canonical_url(final), asked)


def crawl_host(url: Column) -> Column:
    """Lower-case host without user and port; NULL where there is none."""
    host = F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":\d*$", "")
    return F.when(host != "", host)


def graph_host(url: Column) -> Column:
    """Lower-case text between ``://`` and the next of ``/ ? #``, port included; NULL without either."""
    host = F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))
    return F.when(host != "", host)


def rank_host(url: Column) -> Column:
    """As :func:`graph_host`, but ``#`` doesn't end a host, and without ``://`` the whole string counts."""
    return F.lower(F.substring_index(F.substring_index(F.regexp_replace(url, "^.*?://", ""), "/", 1), "?", 1))


def path_segments(url: Column) -> Column:
    """Lower-case non-empty parts of the path."""
    bare = F.substring_index(F.substring_index(F.regexp_replace(url, "^.*?://", ""), "?", 1), "#", 1)
    inner = F.when(F.instr(bare, "/") > 0, F.regexp_replace(bare, "^[^/]*/", "")).otherwise("")
    return F.filter(F.split(F.lower(inner), "/"), lambda s: s != "")


def query_param_names(url: Column) -> Column:
    """Lower-case names of the parameters, parted by ``&`` or ``;``."""
    asked = F.regexp_extract(url, r"\?(.*)$", 1)
    return F.filter(F.transform(F.split(asked, "[&;]"), lambda p: F.lower(F.trim(F.substring_index(p, "=", 1)))), lambda n: n != "")


def host_label(url: Column) -> Column:
    """The name a site is known by: ``example`` of ``www.example.co.uk:8080``."""
    host = F.regexp_replace(F.regexp_replace(rank_host(url), r":.*$", ""), r"^www\.", "")
    parts = F.filter(F.split(host, r"\."), lambda p: p != "")
    n = F.size(parts)
    return F.when((n >= 3) & F.get(parts, n - 2).isin(*sorted(SECOND_LEVEL)), F.get(parts, n - 3)).when(n >= 2, F.get(parts, n - 2)).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))


def is_probably_page(url: Column) -> Column:
    """Whether the last segment of the path has no extension of a file that is no page; one ``.gz`` is looked through."""
    last = F.regexp_replace(F.lower(F.substring_index(path(url), "/", -1)), r"\.gz$", "")
    extension = F.regexp_extract(last, r"^.+\.([^.]*)$", 1)
    return F.coalesce((scheme(url) != "") & ~extension.isin(*sorted(NOT_PAGES)), F.lit(False))


def is_sitemap_url(url: Column) -> Column:
    return F.coalesce((scheme(url) != "") & F.lower(path(url)).rlike(r"\.xml(\.gz)?$"), F.lit(False))


def is_xml_content_type(kind: Column) -> Column:
    low = F.lower(kind)
    return F.coalesce(low.contains("xml") & ~low.contains("html"), F.lit(False))


def is_html_content_type(kind: Column) -> Column:
    """Types that are fetched at all: unknown, HTML or XML."""
    low = F.lower(kind)
    return kind.isNull() | low.contains("html") | low.contains("xml")


def classify(url: Column, kind: Column) -> Column:
    """page or sitemap, by the content type, else by the URL."""
    low = F.lower(kind)
    return F.when(F.coalesce(low.contains("html"), F.lit(False)), "page").when(is_xml_content_type(kind) | is_sitemap_url(url), "sitemap").otherwise("page")


def request_path(url: Column) -> Column:
    """Path and query, as robots rules see them."""
    return F.concat(path(url), _group(url, 4))


def robots_url(url: Column) -> Column:
    return F.when(is_web(url), F.concat(scheme(url), F.lit("://"), authority(url), F.lit("/robots.txt")))


def _stem(segment: Column) -> Column:
    return F.regexp_replace(segment, r"\.[^.]*$", "")


def is_search_view(url: Column) -> Column:
    """A results page: a search-like segment (its extension aside) or parameter."""
    return F.exists(path_segments(url), lambda s: _stem(s).isin(*sorted(SEARCH_SEGMENTS))) | F.exists(query_param_names(url), lambda n: n.isin(*sorted(SEARCH_PARAMS)))


def is_legal(url: Column) -> Column:
    """Some segment begins with a word of legal pages."""
    return F.exists(path_segments(url), lambda s: F.coalesce(F.get(F.filter(F.split(_stem(s), "[-_]"), lambda t: t != ""), F.lit(0)), F.lit("")).isin(*sorted(LEGAL)))


def url_quality(url: Column, legal: float = 0.3, locale: float = 0.55, search: float = 0.3, decay: float = 0.93, floor: float = 0.55, home: float = 1.15) -> Column:
    """What a URL's shape multiplies a text score by."""
    if min(legal, locale, search, decay, floor) <= 0:
        raise ValueError("penalties are above zero")
    segments = path_segments(url)
    n = F.size(segments)
    foreign = F.exists(segments, lambda s: (s == "intl") | s.rlike("^[a-z]{2}[-_][a-z0-9]{2,4}$"))
    times = lambda test, factor: F.when(test, factor).otherwise(1.0)
    deep = F.greatest(F.lit(floor), F.pow(F.lit(decay), n - 2))
    if decay < 1:
        # The few powers above the floor as this machine's library has them: Java's are off by a last bit in one of ten cases.
        steps = [1.0]
        while steps[-1] > floor and len(steps) < 1000:
            steps.append(decay ** len(steps))
        deep = F.coalesce(F.get(F.array(*(F.lit(max(floor, x)) for x in steps)), n - 2), F.lit(floor) if steps[-1] <= floor else deep)
    depth = F.when(n == 0, home).when(n > 2, deep).otherwise(1.0)
    return times(is_legal(url), legal) * times(foreign, locale) * times(is_search_view(url), search) * depth


def breadcrumb(url: Column) -> Column:
    """Host without ``www.`` and up to three segments."""
    bare = F.substring_index(F.substring_index(F.regexp_replace(url, "^.*?://", ""), "?", 1), "#", 1)
    names = F.slice(F.filter(F.split(F.regexp_replace(bare, "^[^/]*/?", ""), "/"), lambda s: s != ""), 1, 3)
    return F.array_join(F.concat(F.array(F.regexp_replace(rank_host(url), r"^www\.", "")), F.transform(names, lambda s: F.coalesce(F.try_url_decode(s), s))), " › ")
