"""robots.txt: parsing, choice of group, and rules as a join."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIST = T.ArrayType(T.StringType())
RULES = T.StructType([T.StructField("crawl_delay_s", T.LongType()), T.StructField("disallow", _LIST), T.StructField("allow", _LIST), T.StructField("sitemaps", _LIST)])


def _delay(value: str) -> int | None:
    try:
        seconds = float(value)
    except ValueError:
        return None
    return math.ceil(seconds) if math.isfinite(seconds) and seconds >= 0 else None


def parse(body: str | None, agent: str) -> dict:
    """The rules that hold for an agent, and the file's sitemaps.

    Agent lines in a row open a group; rules close the row. The group with the longest agent that the given one contains is
    taken, ``*`` counting as none, the first of equals. Without a group everything is allowed.
    """
    groups, agents, rules, sitemaps = [], [], {}, []

    def close() -> None:
        if rules and agents:
            groups.append((list(agents), dict(rules)))

    for line in (body or "").splitlines():
        name, colon, value = line.partition("#")[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if rules:
                close()
                agents.clear(), rules.clear()
            agents.append(value.lower())
        elif name in ("allow", "disallow"):
            rules.setdefault(name, [])
            rules[name] = rules[name] + [value] * bool(value)
        elif name == "crawl-delay":
            rules.setdefault("delay", None)
            if (seconds := _delay(value)) is not None:
                rules["delay"] = seconds
        elif name == "sitemap" and value:
            sitemaps.append(value)
    close()
    mine, low = None, agent.lower()
    for names, found in groups:
        for n in names:
            if n == "*" or n in low:
                size = 0 if n == "*" else len(n.encode())
                if mine is None or size > mine[0]:
                    mine = size, found
    chosen = mine[1] if mine else {}
    return {"crawl_delay_s": chosen.get("delay"), "disallow": chosen.get("disallow", []), "allow": chosen.get("allow", []), "sitemaps": sitemaps}


def parse_robots(body: Column, agent: str) -> Column:
    @F.pandas_udf(RULES)
    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t, agent) for t in texts], columns=["crawl_delay_s", "disallow", "allow", "sitemaps"]).astype({"crawl_delay_s": "Int64"})

    return each(body)


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: ``*`` matches anything, a final ``$`` the end, all else itself from the start."""
    bare = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(bare, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))


def specificity(pattern: Column) -> Column:
    return F.octet_length(F.regexp_replace(pattern, r"\$$", ""))


def allowed(paths: DataFrame, rules: DataFrame, on: str = "host", path: str = "path") -> DataFrame:
    """``paths`` with ``allowed``: the longest matching rule of its host decides, Disallow on a tie; without one a path is allowed.

    ``rules`` holds (host, pattern, is_allow). A host's rules travel as one array, so each path is one row throughout: repeated
    rows stay, and nothing is grouped by path. A robots.txt is cut at 500 KiB by its readers, which bounds the array.
    """
    each = F.struct(pattern_regex(F.col("pattern")).alias("regex"), specificity(F.col("pattern")).alias("n"), (~F.col("is_allow")).alias("no"))
    own = rules.groupBy(F.col(on).alias("__on")).agg(F.collect_list(each).alias("__rules"))
    hits = F.expr(f"filter(__rules, r -> `{path}` RLIKE r.regex)")
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["n"], r["no"])))
    met = paths.join(own, F.col(on) == F.col("__on"), "left")
    return met.select(*(F.col(f"`{c}`") for c in paths.columns if c != "allowed"), F.coalesce(~best["no"], F.lit(True)).alias("allowed"))


def policy_when_missing(status: Column) -> Column:
    """What holds if robots.txt isn't there: all is allowed for a day after a 404, nothing for five minutes after another failure."""
    return F.when(status == 404, F.struct(F.lit(True).alias("allow_all"), F.lit(86400).alias("ttl_s"))).otherwise(F.struct(F.lit(False).alias("allow_all"), F.lit(300).alias("ttl_s")))


#: Where a sitemap lies by custom, if robots.txt names none.
USUAL_SITEMAPS = ("/sitemap.xml", "/sitemap.xml.gz", "/sitemap_index.xml", "/sitemap-index.xml")


def named_sitemaps(body: Column, origin: Column) -> Column:
    """The sitemaps that a robots.txt names, in order; relative ones belong to its origin."""
    values = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?im)^[\t ]*sitemap[\t ]*:[\t ]*(\S[^\r\n]*?)[\t ]*$"), F.lit(1))
    scheme = F.substring_index(origin, "//", 1)
    return F.transform(values, lambda v: F.when(v.rlike("(?i)^[a-z][a-z0-9+.-]*:"), v).when(v.startswith("//"), F.concat(scheme, v)).when(v.startswith("/"), F.concat(origin, v)).otherwise(F.concat(origin, F.lit("/"), v)))


def discover_sitemaps(sites: DataFrame, answering: DataFrame) -> DataFrame:
    """(site, sitemap) of sites (site, robots): those that robots.txt names, else the first usual place among the URLs (url) that answer."""
    named = sites.select("site", named_sitemaps(F.col("robots"), F.col("site")).alias("named"))
    told = named.select("site", F.explode("named").alias("sitemap"))
    guesses = F.array(*(F.struct(F.lit(i).alias("n"), F.concat("site", F.lit(p)).alias("url")) for i, p in enumerate(USUAL_SITEMAPS)))
    tried = named.filter(F.size("named") == 0).select("site", F.explode(guesses).alias("g")).select("site", "g.*")
    found = tried.join(answering.select("url").distinct(), "url", "left_semi").groupBy("site").agg(F.min_by("url", "n").alias("sitemap"))
    return told.unionByName(found)
