"""Operator 1, quality rules with risk-controlled cutoffs, in DataFrame functions only.

Labelled rows are a holdout. For each stratum, rule and cutoff of a fixed grid, the
exact binomial tail tells whether the cutoff rejects more than the allowed share of
good rows; Bonferroni's correction covers all tests at once. Of the cutoffs that pass,
the one that gains most is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm._shared import durable

#: Severity of each rule, in thousandths; more is worse.
RULES = {
    "symbols": "1000 * n_symbols DIV word_chars",
    "duplicate_lines": "10000 * n_dup_lines DIV n_words",
    "repeated_words": "1000 * n_repeat_words DIV n_words",
    "word_length": "100 * word_chars DIV n_words",
}
#: Cutoffs tried for each rule.
GRID = (5, 10, 20, 35, 50, 75, 100, 150, 200, 300, 400, 500, 650, 800, 1000, 2000)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_WORDS = r"filter(split(translate({text}, '\t\n\u000B\u000C\r', '     '), ' '), w -> w <> '')"
_SAME = "({a}.h = {b}.h AND w[{a}.i] = w[{b}.i] AND w[{a}.i + 1] = w[{b}.i + 1] AND w[{a}.i + 2] = w[{b}.i + 2])"
#: Words in 3-word windows found twice or more: windows sorted by hash, neighbours compared word by word, starts merged.
_REPEATS = f"""transform(array({{words}}), w -> transform(array(sort_array(
    transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> struct(xxhash64(x, w[i + 1], w[i + 2]) AS h, i AS i)))), s -> aggregate(
    sort_array(transform(filter(transform(s, (e, j) -> struct(e.i AS i,
        CASE WHEN j > 0 AND {_SAME.format(a="e", b="s[j - 1]")} THEN true WHEN j + 1 < size(s) THEN {_SAME.format(a="e", b="s[j + 1]")} ELSE false END AS twice)), e -> e.twice), e -> e.i)),
    named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n))[0])[0]"""


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES`` and ``base_failed``, each from the whole text of its row. Columns of these names are replaced."""
    docs = docs.drop(*MEASURES, "base_failed").withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    words = _WORDS.format(text="__text")
    lines = r"filter(split(__text, '\n'), l -> translate(l, ' \t\n\u000B\u000C\r', '') <> '')"
    out = docs.selectExpr(
        *(f"`{c}`" for c in docs.columns if c != "__text"),
        f"cast(size({words}) AS bigint) AS n_words",
        r"cast(length(translate(__text, ' \t\n\u000B\u000C\r', '')) AS bigint) AS word_chars",
        "cast(length(__text) - length(translate(__text, '#*$%&|<>', '')) AS bigint) AS n_symbols",
        f"transform(array({lines}), l -> cast(size(l) - size(array_distinct(l)) AS bigint))[0] AS n_dup_lines",
        f"{_REPEATS.format(words=words)} AS n_repeat_words",
    )
    return out.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL for P(X <= k) of a binomial X, exact but for rounding: terms by recurrence, summed as logarithms."""
    term = f"(a.t + ln(({n} - i + 1) / i) + {{odds}})".replace("{odds}", f"ln({p!r}D / (1 - {p!r}D))")
    start = f"{n} * ln(1 - {p!r}D)"
    return f"""exp(aggregate(filter(sequence(0L, {k}), i -> i > 0), named_struct('t', {start}, 's', {start}), (a, i) -> named_struct('t', {term},
        's', greatest(a.s, {term}) + ln(1 + exp(-abs(a.s - {term})))), a -> a.s))"""


def cutoffs(labelled: DataFrame, stratum: str = "stratum", good: str = "good", risk: float = 0.04, error: float = 0.05, price: float = 20.0) -> DataFrame:
    """(stratum, rule, cutoff) of the rules that may be used, from rows with the measures, a stratum and whether they are good.

    With probability 1 - ``error``, over all strata, rules and cutoffs together, no stratum loses more than the share ``risk`` of
    its good rows: each rule has an equal part of the risk, and a cutoff counts only if the exact tail of the binomial with
    that share, at the number of good rows it rejects, is at most error / tests. Of those, the cutoff with the most bad rows
    rejected, less ``price`` for each good one, is taken, the mildest if several tie; a rule without gain is left out. Rows that fail
    the base rules or have no label aren't counted, repeated ones are; a null stratum joins none, so give it a name. An empty table
    certifies nothing.
    """
    share = risk / len(RULES)
    usable = labelled.filter(f"NOT base_failed AND {good} IS NOT NULL")
    levels = usable.select(stratum, good, F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.expr(f"{value}").alias("value")) for rule, value in RULES.items()))).alias("r")).select(stratum, good, "r.*")
    level = F.lit(0)
    for cut in GRID:
        level = level + (F.col("value") >= cut).cast("int")
    counted = levels.groupBy(stratum, "rule", level.alias("level")).agg(F.sum(F.col(good).cast("long")).alias("ok"), F.sum((~F.col(good)).cast("long")).alias("bad"))
    # A row of level l is rejected by the first l cutoffs.
    tried = counted.select(stratum, "rule", "ok", "bad", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("cut")).groupBy(stratum, "rule", "cut").agg(F.sum("ok").alias("k"), F.sum("bad").alias("bad"))
    n = tried.filter("cut = 0").select(stratum, "rule", F.col("k").alias("n"))
    tests = f"{len(RULES) * len(GRID)} * count(DISTINCT {stratum})"
    strata = tried.agg(F.expr(tests).alias("tests"))
    passed = (
        tried.filter("cut > 0").join(n, [stratum, "rule"]).join(F.broadcast(strata))  # one row
        .filter(f"n > 0 AND k <= n * {share!r}D AND bad > {price!r}D * k")
        .filter(f"{binomial_tail('k', 'n', share)} * tests <= {error!r}D")
    )
    best = passed.groupBy(stratum, "rule").agg(F.max_by("cut", F.struct(F.expr(f"bad - {price!r}D * k"), "cut")).alias("cut"))
    return best.select(stratum, "rule", F.element_at(F.array(*map(F.lit, GRID)), F.col("cut")).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", **how) -> DataFrame:
    """``docs`` without its text, with the measures, ``base_failed``, ``rejected_by`` (rules, in order of name) and ``kept``.

    Words are runs without space or the controls 9 to 13; a null text has none. ``kept`` is false where the base rules fail or a
    rule's cutoff for the row's stratum is reached. A null stratum is one of its own. Labels without an id or a label are left
    out; of several for one id the least counts. Repeated rows stay; an empty table gives no rows; without labels no cutoff is
    certified and the base rules alone decide. Columns of ``docs`` with the names of the result's are replaced.
    """
    gone = [*MEASURES, "base_failed", "rejected_by", "kept"]
    rows = durable(measures(docs.drop(*gone), text_col).drop(text_col).withColumn("__stratum", F.coalesce(F.col(stratum_col).cast("string"), F.lit("\0"))))
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.min(label_col) == 1).alias("good"))
    labelled = rows.join(marks, F.col(id_col) == F.col("__id")).select("__stratum", "good", *MEASURES, "base_failed")
    chosen = cutoffs(labelled, "__stratum", **how).groupBy("__stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in RULES))
    fired = F.array_compact(F.array(*(F.when(F.expr(f"n_words > 0 AND {value} >= __{rule}"), F.lit(rule)) for rule, value in sorted(RULES.items()))))
    out = rows.join(chosen, "__stratum", "left").withColumn("rejected_by", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(fired))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("__stratum", *(f"__{r}" for r in RULES))
