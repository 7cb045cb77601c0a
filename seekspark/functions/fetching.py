"""What a crawler decides from a response: delays, retries, charset, record ids, the text itself."""

from __future__ import annotations

import codecs
import re
import zlib
from html import escape, unescape
from html.entities import html5

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


GZIP = b"\x1f\x8b"
#: windows-1252 by byte; the five that it leaves open are the controls of the same number.
_BYTES = "".join(bytes([x]).decode("cp1252", "ignore") or chr(x) for x in range(256))


def is_retryable_status(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def backoff_ms(attempt: Column, base: int = 250, cap: int = 30_000) -> Column:
    """Doubling delays up to a cap."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(63))), F.lit(float(cap))).cast("long")


def parse_retry_after(header: Column) -> Column:
    """Milliseconds of a Retry-After of whole seconds; NULL for dates and other text."""
    text = F.trim(header)
    seconds = F.regexp_replace(text, r"^\+", "").try_cast("long")
    return F.when(text.rlike(r"^\+?\d+$"), F.when(seconds <= 2**63 // 1000 - 1, seconds * 1000).otherwise(F.lit(2**63 - 1)))


def retry_delay_ms(retry_after: Column, backoff: Column, jitter: Column, cap: int = 30_000) -> Column:
    """How long to wait for another try; NULL to give up, where the server asks for more than the cap."""
    return F.when(F.coalesce(retry_after > cap, F.lit(False)), None).otherwise(F.greatest(F.coalesce(retry_after, F.lit(0)), backoff + jitter))


def politeness_delay_ms(crawl_delay_s: Column, default: int = 1000) -> Column:
    return F.greatest(F.lit(default).cast("long"), F.coalesce(crawl_delay_s * 1000, F.lit(0)))


def charset_of(content_type: Column) -> Column:
    """The charset that a content type names, lower-case; NULL if none."""
    found = F.lower(F.regexp_replace(F.regexp_extract(content_type, r"(?i)charset=([^; \t]*)", 1), "^[\"']+|[\"']+$", ""))
    return F.when(found != "", found)


def iso8601(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


@F.pandas_udf(T.LongType())
def content_hash(text: pd.Series) -> pd.Series:
    """XXH3-64 of the UTF-8 bytes, as a signed long."""
    h = text.map(lambda x: xxhash.xxh3_64_intdigest(x.encode()), na_action="ignore")
    return h.map(lambda x: x - 2**64 if x >= 2**63 else x, na_action="ignore").astype("Int64")


@F.pandas_udf(T.StringType())
def record_id(url: pd.Series, seconds: pd.Series) -> pd.Series:
    """A URN that a URL and time always get."""

    def one(u: str, t: int) -> str:
        a, b = (xxhash.xxh3_64_intdigest(f"{x}\x01{y}".encode()) for x, y in ((u, t), (t, u)))
        x = f"{a:016x}{b:016x}"
        return f"urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"

    return pd.Series([one(u, t) for u, t in zip(url, seconds)])


@F.pandas_udf(T.LongType())
def jitter_ms(url: pd.Series, attempt: pd.Series, nanos: pd.Series) -> pd.Series:
    return pd.Series([xxhash.xxh3_64_intdigest(f"{u}:{a}:{n}".encode()) % 250 for u, a, n in zip(url, attempt, nanos)])


#: Labels that the web reads as windows-1252, whatever their names say.
_WINDOWS_1252 = frozenset("ansi_x3.4-1968 ascii cp1252 cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii windows-1252 x-cp1252".split())


def inflated(body: bytes, most: int = 8 << 20) -> bytes:
    """A gzip body as it was, up to ``most`` bytes; one that is broken or cut off, or no gzip, as it is."""
    if body[:2] != GZIP:
        return body
    unzip = zlib.decompressobj(31)
    try:
        out = unzip.decompress(body, most)
    except zlib.error:
        return body
    return out if unzip.eof or len(out) == most else body


def decode(body: bytes | None, charset: str | None, most: int = 8 << 20) -> str | None:
    """A body as text: inflated if it is gzip, by its charset if that is known to the web, else as UTF-8 with replacements."""
    if body is None:
        return None
    name = (charset or "utf-8").strip().lower()
    if name in _WINDOWS_1252:
        return codecs.charmap_decode(inflated(body, most), "replace", _BYTES)[0]
    try:
        codecs.lookup(name)
        return inflated(body, most).decode(name, "replace")
    except LookupError:
        return inflated(body, most).decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decode_body(body: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([decode(b, c) for b, c in zip(body, charset)])


_MARKS = re.compile(r"(</?b>)")


_REFERENCE = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _whole_reference(m: re.Match) -> str:
    return unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]


def safe_text(snippet: str | None) -> str:
    """A snippet for a page: its own ``<b>`` marks stay, all else is escaped once. A reference ends with a semicolon; one cut off is text."""
    return "".join(p if _MARKS.fullmatch(p) else escape(_REFERENCE.sub(_whole_reference, p)) for p in _MARKS.split(snippet or ""))


@F.pandas_udf(T.StringType())
def safe_snippet(snippets: pd.Series) -> pd.Series:
    return snippets.map(safe_text)
