"""Operators 2, 4 and 10 against brute force."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekspark.llm import components, simhash, substring, suffix_dedup
from seekspark.llm.suffix_array import common_prefixes, suffix_array


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=50))
def test_suffix_array(symbols):
    text = np.array(symbols, np.int64)

    def suffix(i):
        out = []
        for j in range(i, len(symbols)):
            out.append((symbols[j], j if symbols[j] == 0 else 0))
            if symbols[j] == 0:
                return out
        return [*out, (0, len(symbols))]

    order = sorted(range(len(symbols)), key=suffix)
    assert suffix_array(text).tolist() == order
    shared = common_prefixes(text, np.array(order, np.int64), 9)
    for k in range(1, len(order)):
        a, b = suffix(order[k - 1]), suffix(order[k])
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y or x[0] == 0), min(len(a), len(b)))
        assert shared[k] == min(n, 9)


def bytes_of(df, **how):
    out = suffix_dedup.remove_repeated_bytes(df, **how)
    return out.select("id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()


def words_of(df, **how):
    out = substring.remove_repeated_windows(df, **how)
    return out.select("id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()


def test_bytes(edges, edge_rows):
    assert {r[0]: tuple(r)[1:] for r in bytes_of(edges)} == brute.repeated_bytes(edge_rows)


def test_words(edges, edge_rows):
    assert {r[0]: tuple(r)[1:] for r in words_of(edges)} == brute.repeated_words(edge_rows)


def test_blocks_and_common_grams(spark):
    """One passage in every text with other words around it: whichever grams are avoided as anchors, over many blocks, results are the same."""
    rng = random.Random(8)
    passage = " ".join(f"shared{i}" for i in range(5))
    rows = [(i, f"{prose(rng, 12)} {passage} {prose(rng, 12)}") for i in range(60)] + [(100 + i, f"{passage} tail{i % 4} {passage * 2}") for i in range(12)]
    for how in ({}, {"block": 200}, {"block": 90, "n_parts": 13}):
        assert {r[0]: tuple(r)[1:] for r in words_of(frame(spark, rows), window=5, **how)} == brute.repeated_words(rows, 5)
        for sample in ({}, {"sample": 0}, {"held_by": 2}, {"sample": 30, "held_by": 3}):
            assert {r[0]: tuple(r)[1:] for r in bytes_of(frame(spark, rows), length=20, **sample, **how)} == brute.repeated_bytes(rows, 20)


def test_messages_follow_the_partitions(spark):
    """A chunk sends a bucket one row, whatever the rows of the table."""
    from seekspark.llm import _repeats

    rng = random.Random(6)
    df = frame(spark, [(i, prose(rng, 60, 100_000)) for i in range(400)])
    for n in (4, 8):
        sizes = []

        def settle(made):
            sizes.append(made.filter("kind = 1").count())
            return made

        anchors = lambda t: _repeats.Anchors(np.arange(t.num_rows, dtype=np.uint64), np.arange(t.num_rows + 1), 1, 1)
        sent = lambda table, each, n: (b"", [i for i in range(n)] if list(each) else [], {"data": pa.array([b"x"] * n)})
        _repeats.find(df, "doc_id", "text", anchors, sent, settle, lambda t, a: t.select(["id"]), "id long", n_parts=n)
        assert sizes == [n * n]
        found = _repeats.keys(spark, n).tolist()
        assert sorted(r["p"] for r in spark.createDataFrame([(k,) for k in found], "k int").select(F.pmod(F.hash("k"), F.lit(n)).alias("p")).collect()) == list(range(n))


def test_rows_repeated_often(spark, repeated):
    text = prose(random.Random(2), 80)
    rows = [(5, text)] * 500 + [(None, text)] * 300 + [(6, text)] * 2
    got = sorted(((r[0] or 0), r[2]) for r in words_of(frame(spark, rows)))
    assert got == [(0, 80)] * 300 + [(5, 0)] * 500 + [(6, 80)] * 2
    assert len(bytes_of(repeated)) == repeated.count() and {r[0]: r[2] for r in bytes_of(frame(spark, rows))}[5] == 0


@pytest.mark.parametrize("seed, alphabet", [(1, 2), (2, 3), (3, 9)])
def test_dense_repeats(spark, seed, alphabet):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(60), alphabet)) for i in range(40)]
    df = frame(spark, rows)
    assert {r[0]: tuple(r)[1:] for r in bytes_of(df, length=20)} == brute.repeated_bytes(rows, 20)
    assert {r[0]: tuple(r)[1:] for r in words_of(df, window=5)} == brute.repeated_words(rows, 5)


def test_empty_tables(spark, nothing):
    assert bytes_of(nothing) == [] and words_of(nothing) == []
    assert simhash.classes(nothing).collect() == []
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_repeated_rows(repeated):
    """Rows of one id take nothing from each other; a greater id loses what it shares, and null is the greatest."""
    got = bytes_of(repeated)
    assert len(got) == 7
    assert all((r["n_removed"] == 0) == (r["id"] == 1 or r["n_bytes"] == 0) for r in got)
    assert all((r["n_removed"] == 0) == (r["id"] == 1 or r["n_words"] == 0) for r in words_of(repeated))


def check_classes(df, rows):
    fps = {i: brute.fingerprint(t) for i, t in rows}
    want = {i: (fps[i], c) for i, c in brute.components(fps).items()}
    assert {r["id"]: (r["fp"] % 2**64, r["component"]) for r in simhash.classes(df).collect()} == want


def test_simhash(edges, edge_rows):
    check_classes(edges, edge_rows)


def test_simhash_tiles(spark, edges, edge_rows, monkeypatch):
    """Keys with more rows than a tile are compared in pieces, and nothing is lost."""
    monkeypatch.setattr(simhash, "TILE", 2)
    check_classes(edges, edge_rows)
    rng = np.random.default_rng(7)
    centre = rng.integers(0, 2**64, 4, dtype=np.uint64)
    fps = {int(c ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64))) for c in centre for k in rng.integers(1, 7, 30)}
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    roots = {r["node"] % 2**64: r["root"] for r in components.components(simhash.links(df)).collect()}
    want = brute.components({f: f for f in fps})
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({f: roots.get(f, f) for f in fps}) == groups(want)


def test_one_of_each(edges, edge_rows, repeated):
    kept = simhash.one_of_each(edges)
    assert kept.columns == edges.columns
    fps = {i: brute.fingerprint(t) for i, t in edge_rows}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({*brute.components(fps).values()})
    assert sorted(r["doc_id"] for r in simhash.one_of_each(repeated).select("doc_id").collect()) == sorted([1, 2])
    left = simhash.one_of_each(repeated).select("doc_id", "text").collect()
    assert [r["doc_id"] for r in left if r["doc_id"] != 2] == [1] and [r["text"] for r in left if r["doc_id"] == 2] == [None]


def test_every_component_keeps_a_row(spark):
    """Unrelated rows stay, without an id or under one that others have; a copy with an id stands for those without."""
    a, b, c, d, e = (prose(random.Random(i), 80, 5000) for i in range(5))
    rows = [(None, a), (None, a), (None, b), (7, c), (7, d), (7, d), (None, e), (9, e), (8, c)]
    assert len({brute.fingerprint(t) for t in (a, b, c, d, e)}) == 5
    left = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(frame(spark, rows)).collect()]
    assert sorted(left, key=str) == sorted([(None, a), (None, b), (7, c), (7, d), (9, e)], key=str)


@pytest.mark.parametrize("under", [1e9, 1.0, 1e-5, 1e-9])
def test_blocks_change_nothing_but_cost(spark, monkeypatch, under):
    """Fingerprints a few bits apart, with few blocks and with many: the same links."""
    monkeypatch.setattr(simhash, "UNDER_A_KEY", under)
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for bits in (1, 3, 4, 4, 5, 9):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), bits)))
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {r["node"]: r["root"] for r in components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    want = brute.components(dict(zip(signed, fps)))
    assert {f: got.get(f, f) for f in signed} == want
    counts = [len(simhash.blocks(n, 4)) for n in (10**5, 10**7, 10**9, 10**11)]
    assert counts == sorted(counts) and counts[0] >= 5
    assert all(sum(simhash.blocks(n, 4)) == 64 for n in (1, 10**6, 10**12))


def test_equal_rows_keep_the_same_one(spark):
    """Rows equal in id and text but for other columns: one stays, the same in every order of the rows."""
    text = prose(random.Random(1), 50)
    rows = [(1, text, f"s{i}") for i in range(6)] + [(None, None, "a"), (None, None, "b")]
    seen = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
        seen.add(tuple(sorted(map(str, simhash.one_of_each(df).collect()))))
    assert len(seen) == 1 and len(seen.pop()) == 2


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (None, 1)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1200)}}
