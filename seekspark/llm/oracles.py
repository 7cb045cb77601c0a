"""DuckDB twins of the corpus queries, where SQL can express them on whole tables."""

from __future__ import annotations

from seekspark.llm import quality
from seekspark.llm.chat import END, TEXT, TURN
from seekspark.llm.license_texts import TEMPLATES
from seekspark.llm.licenses import known_lengths, window_of

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_MEASURES = rf"""m AS MATERIALIZED (SELECT doc_id, coalesce(lang, chr(0)) AS stratum, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines
    FROM (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents)),
    g AS MATERIALIZED (SELECT doc_id, i, w[i : i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents))),
    c AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g), range(3) r(j) WHERE n > 1 GROUP BY doc_id),
    d AS MATERIALIZED (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM m LEFT JOIN c USING (doc_id))"""
_RISK, _ERROR, _PRICE = 0.04, 0.05, 20.0
_SHARE = _RISK / len(quality.RULES)
_LEVEL = " + ".join(f"(value >= {c})::INT" for c in quality.GRID)


def _rules(columns: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns}, '{r}' AS rule, {v.replace(' DIV ', ' // ')} AS value FROM {source}" for r, v in quality.RULES.items())


QUALITY = f"""WITH {_MEASURES},
    y AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    v AS (SELECT stratum, good, rule, {_LEVEL} AS level FROM ({_rules('*', '(SELECT * FROM d JOIN y USING (doc_id) WHERE NOT base_failed)')})),
    t AS MATERIALIZED (SELECT stratum, rule, cut, count(*) FILTER (good AND level >= cut) AS k, count(*) FILTER (NOT good AND level >= cut) AS bad, count(*) FILTER (good) AS n FROM v, range(0, {len(quality.GRID) + 1}) r(cut) GROUP BY ALL),
    p AS (SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE}))) FROM (SELECT unnest(range(0, k + 1)) AS i)) AS tail FROM t WHERE cut > 0 AND n > 0 AND k <= n * {_SHARE} AND bad > {_PRICE} * k),
    b AS (SELECT stratum, rule, {list(quality.GRID)}[arg_max(cut, (bad - {_PRICE} * k) * 100 + cut)] AS cutoff FROM p WHERE tail * {len(quality.RULES) * len(quality.GRID)} * (SELECT count(DISTINCT stratum) FROM t) <= {_ERROR} GROUP BY ALL),
    f AS (SELECT doc_id, string_agg(rule, ',' ORDER BY rule) AS rejected_by FROM ({_rules('doc_id, stratum', 'd WHERE n_words > 0 AND NOT base_failed')}) JOIN b USING (stratum, rule) WHERE value >= cutoff GROUP BY doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by FROM d LEFT JOIN f USING (doc_id)"""

SUFFIXES = """WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
    w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM h)),
    g AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM w) WHERE doc_id > first),
    s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g),
    r AS (SELECT doc_id, i AS a, i + 50 AS b, coalesce(i > before + 50, true) AS opens, least(50, i - coalesce(before, i - 50)) AS fresh FROM s),
    t AS (SELECT doc_id, sum(fresh)::BIGINT AS n_removed, count(*) FILTER (opens)::BIGINT AS n_spans FROM r GROUP BY doc_id),
    x AS (SELECT doc_id, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY a) AS span, a, b FROM r),
    z AS (SELECT doc_id, min(a) AS a, max(b) AS b, lag(max(b), 1, 0) OVER (PARTITION BY doc_id ORDER BY min(a)) AS kept_from FROM x GROUP BY doc_id, span),
    k AS (SELECT doc_id, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM z JOIN h USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM h LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""

_ESCAPED = r"regexp_replace({c}, '<(\\*)\|', '<\\\1|', 'g')"
_SAID = r"\### Assistant: </turn> ok"
CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
    l AS (SELECT *, {len(TURN + TEXT + END)} + length({_ESCAPED.format(c='role')}) + length({_ESCAPED.format(c='text')}) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM c),
    s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM l)
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, (sum(size) + coalesce(sum(upto) FILTER (role = 'assistant'), 0))::BIGINT AS formatted_chars FROM s GROUP BY conv_id"""

DECONTAMINATION = f"""WITH i AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark)),
    t AS MATERIALIZED (SELECT DISTINCT item_id, least(n, 10) AS size, array_to_string(w[a : a + 9], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(n - 9, 1) + 1)) AS a FROM i WHERE n > 0)),
    d AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS w FROM documents),
    m AS MATERIALIZED (SELECT doc_id, a, size, item_id FROM (SELECT doc_id, a, size, array_to_string(w[a : a + size - 1], ' ') AS k FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS a FROM d, (SELECT DISTINCT size FROM t))) JOIN t USING (size, k)),
    h AS (SELECT doc_id, count(DISTINCT a + j)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, a, size FROM m), range(10) r(j) WHERE j < size GROUP BY doc_id),
    s AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)"""

SUBSTRINGS = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
    g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
    r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
    x AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS p FROM r, range(20) t(j)),
    n AS (SELECT doc_id, count(*)::BIGINT AS n_removed FROM x GROUP BY doc_id),
    k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN x USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

_WORDINGS = ", ".join(f"({i}, '{name}', '" + wording.replace("'", "''") + "')" for i, (name, wording) in enumerate((n, w) for n, ws in TEMPLATES.items() for w in ws))
_WINDOW = "(SELECT unnest([{}]) AS v)".format(", ".join(f"{{'n': {n}, 'size': {size}, 'step': {step}}}" for n in sorted(known_lengths()) for size, step in [window_of(n)]))
#: Exact containment in every window that may hold a wording, without any retrieval.
LICENSES = f"""WITH t AS MATERIALIZED (SELECT id, name, w, len(w) AS n, least(5, len(w)) AS k FROM (SELECT id, name, {_ALNUM} AS w FROM (VALUES {_WORDINGS}) AS v(id, name, text))),
    g AS MATERIALIZED (SELECT DISTINCT id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM t)),
    z AS MATERIALIZED (SELECT t.id, t.name, t.k, v.size, v.step, (SELECT count(*) FROM g WHERE g.id = t.id) AS want FROM t JOIN {_WINDOW} ON v.n = t.n - t.k + 1),
    d AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS w FROM documents),
    o AS MATERIALIZED (SELECT doc_id, k, i - 1 AS pos, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t))),
    h AS MATERIALIZED (SELECT o.doc_id, o.pos, o.s, z.* FROM o JOIN g USING (k, s) JOIN z ON z.id = g.id AND z.k = g.k),
    p AS (SELECT doc_id, id, name, size, k, a, count(DISTINCT s) / any_value(want) AS share FROM (SELECT *, unnest(range(greatest(0, pos - size + 1 + (step - (pos - size + 1) % step) % step), pos + 1, step)) AS a FROM h WHERE pos >= size UNION ALL SELECT *, unnest(range(0, pos + 1, step)) AS a FROM h WHERE pos < size) GROUP BY ALL),
    m AS (SELECT p.doc_id, name, a, least(a + size + k - 1, len(w)) AS b, share FROM p JOIN d USING (doc_id) WHERE share >= 0.8),
    r AS (SELECT *, coalesce(a >= max(b) OVER (PARTITION BY doc_id, name ORDER BY a, b, share ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM m),
    f AS (SELECT doc_id, count(*) FILTER (opens)::BIGINT AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, round(max(share), 6) AS containment FROM r GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, coalesce(containment, 0)::DOUBLE AS containment FROM d LEFT JOIN f USING (doc_id)"""

_BUCKETS, _BUDGET = 16, 65536


def _packing() -> str:
    """The dynamic programme layer by layer, every cut tried; then the cuts read backwards, and rows numbered in their buckets."""
    parts = [
        f"d AS MATERIALIZED (SELECT doc_id, len({_WORDS})::BIGINT AS n_tokens FROM documents)",
        "h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n_tokens) - 1 AS j, n_tokens AS len, sum(n) OVER (ORDER BY n_tokens) AS r, sum(n * n_tokens) OVER (ORDER BY n_tokens) AS t FROM (SELECT n_tokens, count(*) AS n FROM d GROUP BY 1))",
        "l0 AS MATERIALIZED (SELECT j, len, r, t, len * r - t AS best, -1::BIGINT AS cut FROM h)",
    ]
    for k in range(1, _BUCKETS):
        parts.append(f"""c{k} AS (SELECT b.j, min(a.best + b.len * (b.r - a.r) - (b.t - a.t)) AS cost, arg_min(a.j, (a.best + b.len * (b.r - a.r) - (b.t - a.t), a.j)) AS cut FROM l{k - 1} a JOIN l{k - 1} b ON a.j < b.j GROUP BY b.j),
            l{k} AS MATERIALIZED (SELECT b.j, len, r, t, CASE WHEN cost < best THEN cost ELSE best END AS best, CASE WHEN cost < best THEN c.cut ELSE -1 END AS cut FROM l{k - 1} b LEFT JOIN c{k} c USING (j))""")
    # Only as many layers as there are lengths.
    parts.append("n AS (SELECT max(j) AS j FROM h), e{0} AS (SELECT j, true AS real FROM n)".format(_BUCKETS))
    for k in range(_BUCKETS - 1, 0, -1):
        parts.append(f"e{k} AS (SELECT CASE WHEN c.cut >= 0 AND {k} <= n.j THEN c.cut ELSE e.j END AS j, c.cut >= 0 AND {k} <= n.j AS real FROM e{k + 1} e JOIN l{k} c USING (j), n)")
    parts.append("x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY len) - 1 AS bucket, len AS bucket_len, coalesce(lag(len) OVER (ORDER BY len), -1) AS above FROM (" + " UNION ".join(f"SELECT len FROM e{k} JOIN h USING (j) WHERE real" for k in range(1, _BUCKETS + 1)) + "))")
    parts.append("p AS (SELECT d.*, bucket, bucket_len, row_number() OVER (PARTITION BY bucket ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || n_tokens), doc_id NULLS FIRST, n_tokens) - 1 AS at_, greatest(1, {0} // greatest(bucket_len, 1)) AS room FROM d JOIN x ON n_tokens > above AND n_tokens <= bucket_len)".format(_BUDGET))
    return "WITH " + ", ".join(parts) + " SELECT doc_id, n_tokens, bucket::BIGINT AS bucket, bucket_len::BIGINT AS bucket_len, (at_ // room)::BIGINT AS batch, (at_ % room)::BIGINT AS slot, (bucket_len - n_tokens)::BIGINT AS padding FROM p"


ORACLES = {
    "op1_quality_rules": QUALITY,
    "op2_suffix_array_dedup": SUFFIXES,
    "op3_chat_formatting": CHAT,
    "op5_packing": _packing(),
    "op7_benchmark_decontamination": DECONTAMINATION,
    "op9_license_scans": LICENSES,
    "op10_substring_dedup": SUBSTRINGS,
}
