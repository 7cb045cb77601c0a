"""Index tokens, query terms, snippets."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of this many bytes or more aren't indexed.
LONGEST = 40
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-case, in order; overlong ones left out. NULL has none."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda t: (t != "") & (F.octet_length(t) < LONGEST))


def query_terms(text: Column) -> Column:
    """The ASCII terms that ranking compares: lower-case letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def title_match(title: Column, terms: list[str]) -> Column:
    """The share of a title's tokens that the distinct terms found in it amount to, 1 at most; 0 if either has none."""
    own = query_terms(title)
    asked = sorted(set(terms))
    if not asked:
        return F.lit(0.0)
    found = F.size(F.array_intersect(own, F.array(*map(F.lit, asked))))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.least(F.lit(1.0), found / F.size(own)))


def cut_snippet(body: str | None, weights: dict[str, float], most: int = 240) -> str:
    """The stretch of up to ``most`` characters with the greatest weight of distinct matched tokens, the first of equals; HTML-escaped, matches in ``<b>``."""
    body = body or ""
    spots = [(m.start(), m.end(), m[0].lower()) for m in _TOKEN.finditer(body) if m[0].lower() in weights]
    best, start, end = -1.0, 0, min(len(body), most)
    for i, (a, _, _) in enumerate(spots):
        held = {t for s, e, t in spots[i:] if e <= a + most}
        if (weight := sum(weights[t] for t in held)) > best + 1e-12:
            best, start = weight, a
    if spots:
        last = max([e for s, e, _ in spots if s >= start and e <= start + most], default=start)
        start = max(0, min(start - (most - (last - start)) // 2, len(body) - most))
        if start and not body[start - 1].isspace():
            start = next((i + 1 for i in range(start, len(body)) if body[i].isspace()), start)
        end = min(len(body), start + most)
        if end < len(body) and not body[end].isspace():
            end = max(last, next((i for i in range(end, start, -1) if body[i].isspace()), end))
    out, at = [], start
    for a, b, _ in spots:
        if a >= at and b <= end:
            out += [html.escape(body[at:a]), "<b>", html.escape(body[a:b]), "</b>"]
            at = b
    return "".join([*out, html.escape(body[at:end])]).strip()


def snippet(body: Column, weights: dict[str, float], most: int = 240) -> Column:
    """:func:`cut_snippet` for the few rows of a page of results."""

    @F.pandas_udf(T.StringType())
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_snippet(t, weights, most))

    return each(body)
