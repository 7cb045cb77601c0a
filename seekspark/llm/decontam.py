"""Operator 7, benchmark decontamination with suffix arrays of the training texts.

Each shard of documents orders the word suffixes that can match: those that begin
with the first words of a test suffix. The rest of a full suffix array is never
visited by a binary search and so is not built. Every test suffix is then searched
in the shard; the longest verbatim match and all places come from its interval.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm._arrow import covered, mix, rolling, slices, utf8, word_hashes, words
from seekspark.llm._shared import durable, extended

#: ASCII but digits and letters parts words; capitals are lowered first.
PARTING = np.ones(256, bool)
PARTING[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of text in one shard.
SHARD = 2 << 20
#: Bytes of benchmark text that are broadcast at once; larger benchmarks are searched for in blocks of this size.
BLOCK_BYTES = 32 << 20

NEW = ("n_words", "n_hit", "matches")
MATCHES = "array<struct<item_id: long, start: int, length: int>>"


@dataclass
class TestSuffixes:
    """The test suffixes that open a window: word hashes of all items end to end, and for each window the number of its item, its first word, words in the window, and words to the item's end."""

    ids: list[int | None]
    codes: np.ndarray
    number: np.ndarray
    start: np.ndarray
    window: np.ndarray
    rest: np.ndarray
    heads: dict[int, np.ndarray]


def _codes(data: np.ndarray, offsets: np.ndarray):
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets, PARTING)
    return word_hashes(data, starts, ends), bounds


def prepare(ids: list[int], texts: list[str | None], window: int, head: int) -> TestSuffixes:
    codes, bounds = _codes(*utf8(pa.array(texts, pa.string())))
    item, start, size, rest = [], [], [], []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for s in range(a, max(b - window, a) + 1 if b > a else a):
            item.append(i), start.append(s), size.append(min(window, b - a)), rest.append(b - s)
    item, start, size, rest = (np.array(x, np.int64) for x in (item, start, size, rest))
    heads = {}
    for n in range(1, head + 1):
        which = np.minimum(size, head) == n
        if which.any():
            heads[n] = np.unique(mix(rolling(codes, n))[start[which]])
    return TestSuffixes(list(ids), codes, item, start, size, rest, heads)


def search(codes: np.ndarray, ends: np.ndarray, tests: TestSuffixes, bits: dict[int, np.ndarray]) -> list[tuple[np.ndarray, ...]]:
    """(place, window of the tests, longest match in words) of each occurrence of a window in a shard of word hashes; ``ends``: the end of each word's document."""
    n = len(codes)
    keep = np.zeros(n, bool)
    for size, known in tests.heads.items():
        h = mix(rolling(codes, size))
        maybe = np.flatnonzero(bits[size][h >> np.uint64(44)])
        maybe = maybe[maybe + size <= ends[maybe]]
        keep[maybe[known[np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)] == h[maybe]]] = True
    sa = np.flatnonzero(keep)
    if not len(sa) or not len(tests.start):
        return []
    most = int(tests.window.max())
    padded = np.concatenate([codes, np.zeros(most + 1, np.uint64)])

    def column(at: np.ndarray, depth: int) -> np.ndarray:
        return np.where(at + depth < ends[np.minimum(at, n - 1)], padded[at + depth], np.uint64(0))

    # The suffix array, as far as windows reach; equal prefixes keep the order of the text.
    sa = sa[np.lexsort([column(sa, d) for d in range(most - 1, -1, -1)])]
    columns = [column(sa, d) for d in range(most)]
    lo, hi = np.zeros(len(tests.start), np.int64), np.full(len(tests.start), len(sa))
    for depth in range(most):
        live = np.flatnonzero((depth < tests.window) & (lo < hi))
        want = tests.codes[tests.start[live] + depth]
        lo[live], hi[live] = _bound(columns[depth], lo[live], hi[live], want, False), _bound(columns[depth], lo[live], hi[live], want, True)
    found = np.flatnonzero(lo < hi)
    if not len(found):
        return []
    count = hi[found] - lo[found]
    which = np.repeat(found, count)
    at = sa[np.repeat(lo[found], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
    length = tests.window[which].copy()
    live = np.arange(len(at))
    while len(live):
        live = live[(length[live] < tests.rest[which[live]]) & (at[live] + length[live] < ends[at[live]])]
        live = live[codes[at[live] + length[live]] == tests.codes[tests.start[which[live]] + length[live]]]
        length[live] += 1
    return [(at, which, length)]


def _bound(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of each value in its own stretch of a column."""
    lo, hi = lo.copy(), hi.copy()
    while (live := lo < hi).any():
        middle = (lo + hi) >> 1
        value = column[np.minimum(middle, len(column) - 1)]
        right = live & ((value <= want) if after else (value < want))
        lo = np.where(right, middle + 1, lo)
        hi = np.where(live & ~right, middle, hi)
    return lo


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES):
    """The items in lists of bounded size, read one partition at a time."""
    ids, texts, held = [], [], 0
    for i, text in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        if held and held + len(text or "") * 4 > most:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(i), texts.append(text)
        held += len(text or "") * 4
    if ids:
        yield ids, texts


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, head: int = 3) -> DataFrame:
    """``docs`` with the columns ``n_words``, ``n_hit`` and ``matches`` (item, first word and words of each longest match that a window opens).

    Words are runs of digits, letters and non-ASCII characters, A-Z lowered. A window is ``window`` consecutive words of an item;
    an item of fewer, but not none, is one window. A word of a document inside an occurrence of a window is hit. A null text, in
    either table, has no words. Equal items each match. A null item_id stays null in the matches. Rows of ``docs`` stay as they
    are, repeated ones too; columns of it named n_words, n_hit or matches are replaced. An empty benchmark matches nothing; an
    empty table of documents gives no rows. The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES``.
    """
    docs = docs.drop(*NEW)
    one_pass = None
    for ids, texts in blocks(benchmark, item_col, item_text_col):
        if one_pass is not None:
            docs = durable(one_pass)
        one_pass = _one_block(docs, prepare(ids, texts, window, head), text_col)
    return one_pass if one_pass is not None else _one_block(docs, prepare([], [], window, head), text_col)


def _one_block(docs: DataFrame, tests: TestSuffixes, text_col: str) -> DataFrame:
    """Search one block of items; matches that are there already, from the blocks before, stay."""
    before = "matches" in docs.columns
    names = [c for c in docs.columns if c not in NEW]
    docs = docs.select(*names, *(["matches"] * before))
    sent = docs.sparkSession.sparkContext.broadcast(vars(tests))  # plain values: workers need no module to read them

    def match(batches):
        t = TestSuffixes(**sent.value)
        bits = {}
        for size, hashes in t.heads.items():
            bits[size] = np.zeros(1 << 20, bool)
            bits[size][hashes >> np.uint64(44)] = True
        for batch in batches:
            data, offsets = utf8(batch.column(names.index(text_col)))
            n_words, n_hit, found = [], [], batch.column(len(names)).to_pylist() if before else [[] for _ in range(batch.num_rows)]
            for i, j in slices(offsets, SHARD):
                codes, bounds = _codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.repeat(bounds[1:], np.diff(bounds))
                for at, which, length in search(codes, ends, t, bits):
                    doc = np.searchsorted(bounds, at, "right") - 1
                    # A match that goes on from one a word earlier is part of that one.
                    order = np.lexsort((at, t.start[which] - at, doc, t.number[which]))
                    at, which, length, doc = at[order], which[order], length[order], doc[order]
                    goes_on = np.zeros(len(at), bool)
                    goes_on[1:] = (at[1:] == at[:-1] + 1) & (t.start[which][1:] == t.start[which][:-1] + 1) & (t.number[which][1:] == t.number[which][:-1])
                    for d, k, a, l in zip(*((x[~goes_on]).tolist() for x in (doc, t.number[which], at - bounds[doc], length))):
                        found[i + d].append({"item_id": t.ids[k], "start": a, "length": l})
                rows = [(d, m["start"], m["length"]) for d in range(j - i) for m in found[i + d]]
                hit = np.zeros(len(codes), bool)
                if rows:
                    d, a, l = np.array(rows).T
                    hit = covered(len(codes), bounds[d] + a, l)
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_words += np.diff(bounds).tolist()
                n_hit += (sums[bounds[1:]] - sums[bounds[:-1]]).tolist()
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, kind)], names=[*names, *NEW])

    return docs.mapInArrow(match, extended(docs.select(*names), f"n_words long, n_hit long, matches {MATCHES}"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with its own columns, in which no window of the benchmark occurs. Nulls and empty tables as in :func:`find_matches`."""
    return find_matches(docs, benchmark, **how).filter("n_hit = 0").select(*docs.columns)
