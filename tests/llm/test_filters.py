"""Operators 1, 7, 8 and 9."""

import math
import random
import zlib

import brute
import numpy as np
from conftest_llm import frame, prose
from pyspark.sql import functions as F

from seekspark.llm import decontam, licenses, quality, queries, toxicity


def test_measures(edges, edge_rows):
    got = {r["doc_id"]: tuple(r[c] for c in quality.MEASURES) for r in quality.measures(edges).collect()}
    assert got == {i: brute.quality(t) for i, t in edge_rows}


def test_binomial_tail(spark):
    for k, n, p in [(0, 10, 0.1), (3, 50, 0.05), (40, 2000, 0.02), (5, 100_000, 0.001)]:
        exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got = spark.range(1).select(F.expr(quality.binomial_tail(f"{k}L", f"{n}L", p))).first()[0]
        assert math.isclose(got, exact, rel_tol=1e-9), (k, n, p)


def labelled(spark, n, bad_share, noise):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(n):
        bad = rng.random() < bad_share
        words = [f"v{rng.randrange(3000)}" for _ in range(60)]
        if bad != (rng.random() < noise):
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        marks.append((i, int(not bad), 0))
    return frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_cutoffs_hold_the_risk(spark):
    docs, labels = labelled(spark, 1500, 0.3, 0.0)
    out = quality.judge(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert {r["quality"]: r["kept"] for r in out} == {0: 0.0, 1: 1.0}
    noisy, marks = labelled(spark, 1500, 0.3, 0.3)
    assert quality.judge(noisy, marks).filter("kept").count() == 1500
    few, marks = labelled(spark, 60, 0.3, 0.0)
    assert quality.judge(few, marks).filter("kept").count() == 60


def test_cutoffs_of_two_strata_are_brute_force(spark):
    """In one stratum symbols tell bad texts, in the other good ones hold as many: each gets its own cutoff, by exact tails over all tests."""
    rng = random.Random(14)
    rows = []
    for stratum, bad_symbols, good_symbols in (("a", 400, 3), ("b", 400, 400)):
        for i in range(1400):
            good = i % 4 > 0
            symbols = int((good_symbols if good else bad_symbols) * rng.uniform(0.9, 1.1))
            rows.append((stratum, good, 100, 1000, symbols, 0, 0, False))
    df = spark.createDataFrame(rows, "stratum string, good boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    share, tests, want = 0.04 / len(quality.RULES), 2 * len(quality.RULES) * len(quality.GRID), {}
    for stratum in "ab":
        own = [(r[1], 1000 * r[4] // r[3]) for r in rows if r[0] == stratum]
        n, best = sum(g for g, _ in own), None
        for place, cut in enumerate(quality.GRID, 1):
            k, bad = sum(g and v >= cut for g, v in own), sum(not g and v >= cut for g, v in own)
            if k > n * share or bad <= 20 * k:
                continue
            tail = math.fsum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
            if tail * tests <= 0.05 and (best is None or (bad - 20 * k, place) > best[0]):
                best = (bad - 20 * k, place), cut
        if best:
            want[stratum, "symbols"] = best[1]
    assert {(r["stratum"], r["rule"]): r["cutoff"] for r in quality.cutoffs(df).collect()} == want and set(want) == {("a", "symbols")}


def test_quality_edges(spark, edges, nothing, repeated):
    labels = spark.createDataFrame([(20, 1, 0), (20, 0, 0), (None, 1, 0), (21, None, None)], "doc_id long, quality int, toxic int")
    out = quality.judge(edges, labels)
    assert out.count() == edges.count() and out.filter("kept AND base_failed").isEmpty()
    assert quality.judge(nothing, labels).count() == 0
    assert quality.judge(repeated, labels.limit(0)).count() == 7
    assert quality.judge(repeated.withColumn("lang", F.lit(None).cast("string")), labels).count() == 7


def items(rng, words=60):
    return [(1, prose(rng, 14, words)), (2, "short item"), (3, None), (4, "..."), (5, "w1 w2"), (6, "w1 w2"), (7, "ÉCOLE 3x")]


def test_decontamination(spark, edge_rows, edges):
    rng = random.Random(2)
    test_items = [*items(rng), (8, " ".join((edge_rows[8][1] or "").split()[5:30])), (9, "w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    rows = [*edge_rows, (200, prose(rng, 4000, 12)), (201, "the SHORT,item école 3X"), (202, (test_items[0][1] or "").replace(" ", "-") + " x")]
    bench = spark.createDataFrame(test_items, "item_id long, text string")
    df = frame(spark, rows, n_words=1, matches="m")
    want = {i: brute.hits(t, test_items) for i, t in rows}
    got = decontam.find_matches(df, bench).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], {m["item_id"] for m in r["matches"]}) for r in got} == want
    clean = decontam.without_contaminated(df, bench)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {i for i, w in want.items() if not w[1]}


def test_longest_matches(spark):
    long = [f"q{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    df = frame(spark, [(1, "a b " + " ".join(long[3:33]) + " c"), (2, " ".join(long[:9])), (3, " ".join(long[:10]))])
    assert {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in decontam.find_matches(df, bench).collect()} == {1: [(1, 2, 30)], 2: [], 3: [(1, 0, 10)]}


def test_decontamination_in_blocks(spark, edge_rows, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(decontam.blocks, "__defaults__", (100,))
    test_items = items(rng)
    rows = [(1, prose(rng, 900, 12)), (2, test_items[0][1]), (3, None)]
    got = decontam.find_matches(frame(spark, rows), spark.createDataFrame(test_items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], {m["item_id"] for m in r["matches"]}) for r in got} == {i: brute.hits(t, test_items) for i, t in rows}


def test_decontamination_empty(spark, nothing, repeated):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_matches(repeated, bench).filter("n_hit = 0").count() == 7
    assert decontam.find_matches(nothing, bench).count() == 0


def toxic_corpus(spark, n=1500):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(n):
        words = [f"v{rng.randrange(800)}" for _ in range(50)]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words[rng.randrange(50)] = rng.choice(["slurish", "slurous", "vilest", "scumlike"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {i: t for i, _, t in marks}


def test_toxicity(spark, nothing, edges):
    docs, labels, truth = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: (r["held_out"], r["score"]) for r in toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (h, _) in got.items())
    held = [i for i, (h, _) in got.items() if h]
    assert len(held) > 200 and np.mean([(got[i][1] >= 0.5) == bool(truth[i]) for i in held]) > 0.97
    assert all(0 <= s <= 1 for _, s in got.values())
    scored = toxicity.score(edges, model)
    assert scored.count() == edges.count() and scored.filter("score IS NULL").isEmpty()
    assert toxicity.score(nothing, model).count() == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.join(labels.filter("toxic = 0"), "doc_id").count() >= 0.98 * (len(truth) - sum(truth.values()))


def test_interaction_is_learned():
    """Terms 1 and 2 harm only together; either alone is as harmless as neither."""
    rng = np.random.default_rng(1)

    def draw(n):
        pairs = rng.random((n, 2)) < 0.5
        texts = [np.unique(np.concatenate([np.flatnonzero(p) + 1, rng.integers(10, 60, 8)])) for p in pairs]
        return texts, pairs.all(axis=1).astype(float)

    model = toxicity.fit(*draw(3000), epochs=40)
    fresh, labels = draw(1000)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in fresh])])
    assert ((model.scores(np.concatenate(fresh), bounds) >= 0.5) == (labels == 1)).mean() > 0.97
    assert model.vectors[1] @ model.vectors[2] > 0


def test_interaction_of_a_balanced_term():
    """Term 1 harms only beside term 2, which is as frequent in either class."""
    rng = np.random.default_rng(3)

    def draw(n):
        labels = rng.random(n) < 0.5
        other = rng.random(n)
        insult, alone = np.where(labels, other < 0.5, other < 0.35), labels & (other >= 0.5)
        mention = np.where(labels, other < 0.5, other >= 0.5)
        texts = [np.unique(np.concatenate([np.flatnonzero(p) + 1, rng.integers(10, 60, 8)])) for p in zip(insult, mention, alone)]
        return texts, labels.astype(float)

    texts, labels = draw(3000)
    held = [np.mean([2 in t for t, y in zip(texts, labels) if y == k]) for k in (0, 1)]
    assert abs(held[0] - held[1]) < toxicity.LEAST_Z * np.sqrt(0.25 * 4 / 3000)
    model = toxicity.fit(texts, labels, epochs=40)
    fresh, marks = draw(1000)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in fresh])])
    assert ((model.scores(np.concatenate(fresh), bounds) >= 0.5) == (marks == 1)).mean() > 0.97
    assert model.vectors[1] @ model.vectors[2] > 0


def test_fit_on_all_terms(spark, monkeypatch):
    """Every term of a long text counts in fitting, whatever its hash."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(6000)) + " " + prose(rng, 20)) for i in range(8)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, marks: seen.extend(map(len, texts)))
    toxicity.train(frame(spark, rows), labels)
    want = []
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5:
            data = np.frombuffer(t.encode(), np.uint8)
            want.append(len(toxicity.terms_of(data, np.array([0, len(data)]))[0]))
    assert sorted(seen) == sorted(want) and min(want) > 5000


def test_no_labels(spark, repeated):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = {r["score"] for r in toxicity.score(repeated, toxicity.train(repeated, none)).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_licenses(spark, edges, nothing):
    mit = licenses.TEMPLATES["MIT"][2]
    cut = mit.split()
    cut[20] = "ELSE"
    rng = random.Random(8)
    rows = [(1, prose(rng, 200) + "\n" + mit + "\n" + prose(rng, 300)), (2, prose(rng, 77) + " " + " ".join(cut)), (3, "x released UNDER the mit license."), (4, "released under the license"), (5, None), (6, ""), (7, "All rights reserved"), (8, "all rights are reserved"), (9, " ".join(mit.split()[:20]))]
    got = {r["doc_id"]: [(m["license"], m["start"]) for m in r["licenses"]] for r in licenses.scan(frame(spark, rows, n_words=0, licenses=1)).collect()}
    assert {i: sorted({n for n, _ in m}) for i, m in got.items()} == {1: ["MIT"], 2: ["MIT"], 3: ["MIT"], 4: [], 5: [], 6: [], 7: ["all-rights-reserved"], 8: [], 9: []}
    assert 150 <= got[1][0][1] <= 200
    assert licenses.scan(edges).count() == edges.count() and licenses.scan(nothing).count() == 0


def test_licenses_are_all_windows_compared(spark):
    """Whole texts, notices, edited and cut ones in prose: bands miss none that comparing every window with every wording finds."""
    rng = random.Random(12)
    rows = []
    for i in range(150):
        name = rng.choice(list(licenses.TEMPLATES))
        wording = rng.choice(licenses.TEMPLATES[name]).split()
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            wording[rng.randrange(len(wording))] = "edited"
        if rng.random() < 0.2:
            wording = wording[: max(1, len(wording) * 3 // 4)]
        rows.append((i, f"{prose(rng, rng.randrange(90))} {' '.join(wording)} {prose(rng, rng.randrange(90))}"))
    rows += [(200, " ".join(w for texts in licenses.TEMPLATES.values() for w in texts)), (201, None), (202, ""), (203, "... --- !!!")]
    df = frame(spark, rows + rows[:3])
    got = {r["doc_id"]: [tuple(m) for m in r["licenses"]] for r in licenses.scan(df).collect()}
    want = {i: brute.licenses(t, licenses.TEMPLATES, licenses.window_of) for i, t in rows}
    assert sum(map(len, want.values())) > 120 and got == want
    assert licenses.scan(df).count() == len(rows) + 3
    both = {r["doc_id"]: [tuple(m) for m in r["licenses"]] for r in licenses.scan(frame(spark, rows[:40]), rows=2).collect()}
    assert both == {i: want[i] for i, _ in rows[:40]}


def test_windows_hold_their_templates():
    """A stretch of n shingles lies in one window whole, of which it is enough for the bands, though a fifth is missing."""
    for n in range(1, 3000):
        size, step = licenses.window_of(n)
        assert step == 1 or size >= n + step - 1
        assert 0.8 * n / (size + 0.2 * n) >= licenses.SIMILARITY or size <= 2, n


def test_bands():
    for rows in (1, 2):
        b = licenses.bands(0.5, 0.9999, rows)
        assert 1 - (1 - 0.5**rows) ** b >= 0.9999 > 1 - (1 - 0.5**rows) ** (b - 1)


def test_scores_are_the_naive_sum_over_pairs(spark):
    docs, labels, _ = toxic_corpus(spark, 300)
    model = toxicity.train(docs, labels)
    assert np.abs(model.vectors).max() > 0
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for r in docs.limit(40).collect():
        data = np.frombuffer(r["text"].encode(), np.uint8)
        terms = toxicity.terms_of(data, np.array([0, len(data)]))[0]
        assert abs(brute.fm_score(model.bias, model.weights, model.vectors, terms) - got[r["doc_id"]]) < 1e-4


def test_parity_is_learned():
    """Texts are toxic if they hold exactly one of two terms: alone, neither tells anything."""
    rng = np.random.default_rng(2)

    def draw(n):
        pairs = rng.random((n, 2)) < 0.5
        texts = [np.unique(np.concatenate([np.flatnonzero(p) + 1, rng.integers(10, 60, 8)])) for p in pairs]
        return texts, (pairs[:, 0] ^ pairs[:, 1]).astype(float)

    model = toxicity.fit(*draw(3000), epochs=60)
    fresh, labels = draw(1000)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in fresh])])
    assert ((model.scores(np.concatenate(fresh), bounds) >= 0.5) == (labels == 1)).mean() > 0.97


def test_queries_have_names():
    assert [sum(name.startswith(f"op{n}_") for name in queries.QUERIES) for n in range(1, 11)] == [1] * 10
