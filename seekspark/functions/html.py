"""Text, title, links and description of HTML pages; entities; sitemaps."""

from __future__ import annotations

import gzip
import re
import zlib
from html.entities import name2codepoint
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose text is no content.
FURNITURE = frozenset("aside footer form header iframe nav noscript script style svg template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_LEFT_OUT = frozenset("alefsym dArr hArr image lArr lrm piv rArr real rlm thetasym uArr upsih weierp".split())
ENTITIES = {k: chr(v) for k, v in name2codepoint.items() if k not in _LEFT_OUT} | {"apos": "'", "horbar": "―", "lang": "⟨", "rang": "⟩"}
_SPACE = re.compile(r"\s+")
_REFERENCE = re.compile(r"&([^;&]{1,12});")

LINKS = T.ArrayType(T.StringType())
PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", LINKS), T.StructField("description", T.StringType())])


def _character(body: str) -> str | None:
    if not body.startswith("#"):
        return ENTITIES.get(body)
    try:
        n = int(body[2:], 16) if body[1:2] in ("x", "X") else int(body[1:])
        return chr(n) if 0 <= n < 0x110000 and not 0xD800 <= n < 0xE000 and body[-1].isalnum() else None
    except ValueError:
        return None


def decode(text: str) -> str:
    """Character references with a semicolon, names case-sensitive; others stay as they are."""
    return _REFERENCE.sub(lambda m: c if (c := _character(m[1])) is not None else m[0], text) if "&" in text else text


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


class _Reader(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.depth, self.body, self.chunk = 0, False, []
        self.in_title, self.title, self.titles = False, None, 0
        self.text, self.links, self.base, self.about, self.og = [], [], None, None, None

    def flush(self) -> None:
        chunk, self.chunk = "".join(self.chunk), []
        if not chunk:
            return
        if self.in_title and self.titles == 1 and self.title is None:
            self.title = decode(chunk)
        if self.body and not self.depth:
            self.text.append(decode(chunk))

    def handle_starttag(self, tag, attrs):
        self.flush()
        at = {k: v or "" for k, v in reversed(attrs)}
        if tag == "title":
            self.titles, self.in_title = self.titles + 1, True
        elif tag == "body":
            self.body = True
        elif tag == "a" and "href" in at:
            self.links.append(at["href"])
        elif tag == "base" and "href" in at:
            self.base = at["href"]
        elif tag == "meta":
            if at.get("name") == "description" and self.about is None:
                self.about = collapse(decode(at.get("content", "")))
            elif at.get("property") == "og:description" and self.og is None:
                self.og = collapse(decode(at.get("content", "")))
        if tag in FURNITURE:
            self.depth += 1

    def handle_startendtag(self, tag, attrs):
        depth = self.depth
        self.handle_starttag(tag, attrs)
        self.depth = depth

    def handle_endtag(self, tag):
        self.flush()
        if tag == "title":
            self.in_title = False
        elif tag == "body":
            self.body = False
        elif tag in FURNITURE:
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        self.chunk.append(data)

    def handle_entityref(self, name):
        self.chunk.append(self._written(f"&{name}"))

    def handle_charref(self, name):
        self.chunk.append(self._written(f"&#{name}"))

    def _written(self, bare: str) -> str:
        """The reference as the source has it: the parser hides whether a semicolon ends it."""
        line, column = self.getpos()
        at = self._starts[line - 1] + column
        return bare + ";" * (self._source[at + len(bare) : at + len(bare) + 1] == ";")

    def feed(self, data):
        self._source = data
        self._starts = [0, *(m.end() for m in re.finditer("\n", data))]
        super().feed(data)

    def handle_comment(self, data):
        self.flush()


def normal(url: str) -> str | None:
    """A web URL as its serializer would write it, without a fragment; None for others."""
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return None
    host = parts.hostname + (f":{port}" if port and port != {"http": 80, "https": 443}[parts.scheme] else "")
    path = quote(parts.path or "/", safe="%/:@!$&'()*+,;=~[]|^\\")
    query = quote(parts.query, safe="%/:@!$&()*+,;=~[]|^\\?`{}")
    return f"{parts.scheme}://{host}{path}" + (f"?{query}" if parts.query or re.match(r"[^#]*\?(#|$)", url) else "")


def resolve(hrefs: list[str], base: str) -> list[str]:
    """The web URLs that the links of a page lead to, each once, in order; none from a base that is no URL."""
    if normal(base) is None:
        return []
    out: dict[str, None] = {}
    for href in hrefs:
        href = href.strip()
        if href and not href.startswith("#"):
            try:
                found = normal(urljoin(base, href))
            except ValueError:
                continue
            if found is not None:
                out.setdefault(found)
    return list(out)


def extract(html: str | None, url: str | None) -> tuple[str, str, list[str], str | None]:
    """(title, text, links, description). Without a title the URL stands for it; text comes from the body, outside furniture."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    base = urljoin(url or "", reader.base) if reader.base else url or ""
    return collapse(reader.title or "") or (url or ""), collapse(" ".join(reader.text)), resolve([decode(x) for x in reader.links], base), (reader.about or reader.og) or None


@F.udf(PAGE, useArrow=False)
def extract_page(html: str | None, url: str | None) -> tuple:
    """:func:`extract`. Pages travel a hundred at a time (Arrow: 10,000, whole or up to 64 MB), so a worker's memory doesn't grow with its task's rows."""
    return extract(html, url)


@F.pandas_udf(T.StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    return text.map(decode, na_action="ignore")


@F.pandas_udf(LINKS)
def resolve_links(hrefs: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve([] if h is None else list(h), b or "") for h, b in zip(hrefs, base)])


@F.pandas_udf(LINKS)
def decode_all(texts: pd.Series) -> pd.Series:
    """Character references of all texts of a list."""
    return texts.map(lambda xs: [decode(x) for x in xs], na_action="ignore")


def collapse_whitespace(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def raw_title(html: Column) -> Column:
    """What the first title element holds, references left alone."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)", 1)


def sitemap_urls(body: Column) -> Column:
    """Web URLs of the ``loc`` elements: CDATA unwrapped, references decoded; records that aren't closed are left out."""
    found = F.regexp_extract_all(body, F.lit(r"(?is)<loc(?:\s[^>]*)?>(.*?)</loc"), F.lit(1))
    bare = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))

    return F.filter(decode_all(bare), lambda x: x.rlike("(?i)^https?://"))


def locations(body: bytes | None) -> list[str]:
    """The texts of all ``loc`` elements, whatever their namespace, of XML that may be gzip; none if it is broken."""
    if not body:
        return []
    try:
        root = ElementTree.fromstring(gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body)
    except (ElementTree.ParseError, OSError, EOFError, zlib.error, ValueError, LookupError):
        return []
    found = (e.text.strip() for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "loc" and e.text)
    return [x for x in found if x]


@F.pandas_udf(LINKS)
def xml_locations(body: pd.Series) -> pd.Series:
    """:func:`locations` of binary bodies."""
    return body.map(locations)


def is_sitemap_index(body: Column) -> Column:
    return F.coalesce(body.rlike("(?i)<sitemapindex"), F.lit(False))
