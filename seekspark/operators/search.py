"""Inverted index and BM25, as joins and aggregations over a table of postings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seekspark.functions.text import tokens
from seekspark.plans.query_parser import FIELDS, RAW, Leaf, all_leaves, leaves, parse
from seekspark.sources.tables import durable

K1, B = 1.2, 0.75


def terms_of(field: str) -> Column:
    """The terms under which a field is found: its tokens, or, of a field of ``RAW``, the whole of it."""
    return F.when(F.col(field).isNotNull(), F.array(F.col(field))).otherwise(F.array().cast("array<string>")) if field in RAW else tokens(F.col(field))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` worked out once however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _runs(tokens: Column, asked: Callable[[Column], Column] | None) -> Column:
    """(term, tf, positions) of each different token of a list: sorted with their places, equal ones stand in a row."""
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("at")))
    if asked is not None:
        placed = F.filter(placed, lambda p: asked(p["term"]))

    def cut(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda _, j: j), lambda j: ~F.get(s, j)["term"].eqNullSafe(F.get(s, j - 1)["term"]))

        def run(b: Column, a: Column, k: Column) -> Column:
            n = F.coalesce(F.get(b, k + 1), F.size(s)) - a
            return F.struct(F.get(s, a)["term"].alias("term"), n.alias("tf"), F.transform(F.slice(s, a + 1, n), lambda x: x["at"]).alias("positions"))

        return _bound(starts, lambda b: F.transform(b, lambda a, k: run(b, a, k)))

    return _bound(F.sort_array(placed), cut)


def postings(docs: DataFrame, id_col: str, fields: tuple[str, ...] = FIELDS, asked: Callable[[Column], Column] | None = None, unique: bool | None = None) -> DataFrame:
    """(id, field, term, tf, positions, dl): one row for each term of each field of each document; ``dl`` is the field's number of tokens.

    Documents are spread by id once, as they are; the tokens of each, many times as large, are grouped inside its row, so a task
    holds one document's. Rows of one id count as one document; unless it is known whether ids are ``unique``, they are counted
    first. With ``asked`` only the terms for which it holds.
    """
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), terms_of(f).alias("tokens")) for f in fields)))
    spread = docs.select(F.col(id_col).alias("id"), *fields).repartition("id")

    def posted(rows: DataFrame) -> DataFrame:
        words = rows.select("id", each.alias("f")).select("id", "f.field", "f.tokens")
        return words.select("id", "field", F.size("tokens").alias("dl"), F.explode(_runs(F.col("tokens"), asked)).alias("r")).select("id", "field", "r.term", "r.tf", "r.positions", "dl")

    out = posted(spread)
    if unique if unique is not None else docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        return out
    merged = F.sum("tf").cast("int").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.first("dl").alias("dl")
    return out.groupBy("id", "field", "term").agg(*merged)


def doc_lengths(docs: DataFrame, id_col: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, dl) of every document, those without tokens too."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.size(terms_of(f)).alias("dl")) for f in fields)))
    return docs.select(F.col(id_col).alias("id"), each.alias("f")).select("id", "f.*")


def field_stats(lengths: DataFrame) -> DataFrame:
    """(field, n, avgdl): documents and mean tokens of each field."""
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(posted: DataFrame) -> DataFrame:
    """(field, term, df, cf): documents with the term, and its occurrences."""
    return posted.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, avgdl: Column, n: Column, df: Column, k1: float = K1, b: float = B) -> Column:
    return idf(n, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


@dataclass(frozen=True)
class Matches:
    """Scored documents (id, score), their number, and whether any term sufficed because no document has all."""

    hits: DataFrame
    total: int
    relaxed: bool


def _earlier(n: int):
    return lambda p: p - n


def _asks(leaf: Leaf, term: Column) -> Column:
    """Whether a term is one that a leaf reads."""
    if not leaf.bounds:
        return term.isin(*leaf.terms)
    low, high, with_low, with_high = leaf.bounds
    out = F.lit(True)
    if low is not None:
        out = out & (term >= low if with_low else term > low)
    if high is not None:
        out = out & (term <= high if with_high else term < high)
    return out


def asked(known: list[Leaf]) -> Callable[[Column], Column]:
    """Whether a term is one that some leaf of a query reads."""
    plain = sorted({t for leaf in known if not leaf.bounds for t in leaf.terms})

    def reads(term: Column) -> Column:
        out = term.isin(*plain) if plain else F.lit(False)
        for leaf in known:
            out = out | _asks(leaf, term) if leaf.bounds else out
        return out

    return reads


def _phrase_hits(posted: DataFrame, leaf: Leaf, fields: tuple[str, ...]) -> DataFrame:
    """(id, field, tf, dl) of a leaf: its terms in a row."""
    inside = posted.filter(F.col("field").isin(*([leaf.field] if leaf.field else fields)))
    if leaf.among or leaf.bounds:
        # A document counts once, whatever it has of these terms.
        return inside.filter(_asks(leaf, F.col("term"))).groupBy("id", "field").agg(F.lit(1).alias("tf"), F.first("dl").alias("dl"))
    if len(leaf.terms) == 1:
        return inside.filter(F.col("term") == leaf.terms[0]).select("id", "field", "tf", "dl")
    found = None
    for i, term in enumerate(leaf.terms):
        # Where the phrase would begin if this term is its i-th.
        here = inside.filter(F.col("term") == term).select("id", "field", "dl", F.transform("positions", _earlier(i)).alias(f"at{i}"))
        found = here if found is None else found.join(here.drop("dl"), ["id", "field"]).withColumn("at0", F.array_intersect("at0", f"at{i}")).drop(f"at{i}")
    return found.filter(F.size("at0") > 0).select("id", "field", F.size("at0").alias("tf"), "dl")


def scored(posted: DataFrame, stats: DataFrame, tree, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, score) of the documents that a query tree matches.

    Only the postings of the query's own terms are read; their statistics have a row for each leaf and field and are joined
    back by broadcast, bounded by the query.
    """
    known = all_leaves(tree)
    adds = {x for x in leaves(tree)}
    if not known:
        return posted.select("id", F.lit(0.0).alias("score")).limit(0)
    part = posted.filter(asked(known)(F.col("term")))
    hits = None
    for i, leaf in enumerate(known):
        own = _phrase_hits(part, leaf, fields).withColumn("leaf", F.lit(i)).withColumn("adds", F.lit(leaf.boost if leaf in adds else 0.0)).withColumn("flat", F.lit(bool(leaf.among or leaf.bounds)))
        hits = own if hits is None else hits.unionByName(own)
    df = hits.groupBy("leaf", "field").agg(F.count("*").alias("df"))
    # Sets and ranges tell nothing by frequency: each counts 1.
    value = F.col("adds") * F.when(F.col("flat"), 1.0).otherwise(bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("n"), F.col("df")))
    weighed = hits.join(F.broadcast(df.join(stats, "field")), ["leaf", "field"])
    per = weighed.groupBy("id").agg(F.sum(value).alias("score"), *(F.max(F.col("leaf") == i).alias(f"l{i}") for i in range(len(known))))
    place = {leaf: F.col(f"l{i}") for i, leaf in enumerate(known)}

    def holds(node) -> Column:
        if isinstance(node, Leaf):
            return place[node]
        parts = [holds(p) for p in node.parts]
        out = F.lit(True) if not parts else parts[0]
        for p in parts[1:]:
            out = (out & p) if node.op == "and" else (out | p)
        for w in node.without:
            out = out & ~holds(w)
        return out

    return per.filter(holds(tree)).select("id", "score")


def _own(posted: DataFrame, query: str) -> DataFrame:
    return posted.filter(asked(all_leaves(parse(query)))(F.col("term")))


def _told(stats: DataFrame) -> DataFrame:
    """The statistics as values: a row for each field, which every pass would otherwise count anew."""
    return stats.sparkSession.createDataFrame(stats.collect(), stats.schema)


def match(posted: DataFrame, stats: DataFrame, query: str, fields: tuple[str, ...] = FIELDS) -> Matches:
    """All terms are wanted; if no document has them, and the query has several words, any of them.

    The query's own postings are made once, and kept for as long as the hits are in use.
    """
    part, stats = durable(_own(posted, query)), _told(stats)
    strict = scored(part, stats, parse(query, "and"), fields)
    total = strict.count()
    if not total and len(query.split()) > 1:
        loose = scored(part, stats, parse(query, "or"), fields)
        if n := loose.count():
            return Matches(loose, n, True)
    return Matches(strict, total, False)


@dataclass(frozen=True)
class Best:
    """The best rows (id, score) of a query, and what :class:`Matches` says of all."""

    rows: list
    total: int
    relaxed: bool


def best(posted: DataFrame, stats: DataFrame, query: str, limit: int, offset: int = 0, fields: tuple[str, ...] = FIELDS) -> Best:
    """:func:`match` and :func:`top` in one pass over the query's postings, which are made once: all matches are counted on their way to the best of them."""
    part, stats = _own(posted, query).persist(), _told(stats)

    def run(default: str) -> tuple[list, int]:
        seen = Observation()
        hits = scored(part, stats, parse(query, default), fields).observe(seen, F.count(F.lit(1)).alias("n"))
        rows = top(hits, limit, offset).collect()
        return rows, seen.get["n"]

    try:
        rows, total = run("and")
        if not total and len(query.split()) > 1:
            loose, n = run("or")
            if n:
                return Best(loose, n, True)
        return Best(rows, total, False)
    finally:
        part.unpersist()


def top(hits: DataFrame, limit: int, offset: int = 0, tie: str = "id") -> DataFrame:
    """The best by score; equals stand by ``tie``, ascending."""
    return hits.orderBy(F.desc("score"), F.asc(tie)).offset(offset).limit(max(limit, 1))
