"""Operator 9, license scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Every window of every text is signed. Windows come in a few sizes, each template has the
one that suits its length, and the templates of a size lie in one table by band: a window
looks up its bands there, whatever the number of templates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seekspark.llm._arrow import U64, mix, rolling, slices, utf8, word_hashes, words
from seekspark.llm._shared import extended
from seekspark.llm.decontam import LOWER, PARTING
from seekspark.llm.license_texts import TEMPLATES

SHINGLE = 5
#: A window that holds a stretch with ``containment`` of a template's shingles is at least so similar to it, see :func:`window_of`.
SIMILARITY = 0.41
MATCH = "array<struct<license: string, start: int, end: int, containment: double>>"
SLICE = 1 << 20
GOLD = 0x9E3779B97F4A7C15


def bands(similarity: float, probability: float, rows: int = 1) -> int:
    """How many bands of ``rows`` values let sets of that Jaccard similarity share one with at least that probability."""
    return math.ceil(math.log(1 - probability) / math.log(1 - similarity**rows))


def window_of(n: int) -> tuple[int, int]:
    """Shingles in the windows for a template of n, and the step between their starts: every stretch of n shingles lies in one whole.

    Sizes are powers of two and those times three halves, from which all minima over windows follow by doubling. A window is
    about 12/7 times as large as a template, at most, so a template that misses a fifth of its shingles still makes up 0.41 of
    the union.
    """
    if n <= 1:
        return 1, 1
    size = 2
    while True:
        for s in (size, size * 3 // 2):
            step = max(1, s // 8)
            if s >= n + step - 1:
                return s, step
        size *= 2


@dataclass
class _Template:
    name: str
    #: Words in a shingle, and the distinct shingles.
    words: int
    shingles: np.ndarray
    window: int
    step: int


def template(name: str, text: str) -> _Template | None:
    """None for a text without words."""
    data, offsets = utf8(pa.array([text]))
    data = LOWER[data]
    starts, ends, _ = words(data, offsets, PARTING)
    codes = word_hashes(data, starts, ends)
    if not len(codes):
        return None
    size = min(SHINGLE, len(codes))
    all_of_it = mix(rolling(codes, size))[: len(codes) - size + 1]
    return _Template(name, size, np.unique(all_of_it), *window_of(len(all_of_it)))


def known_lengths(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> set[int]:
    """The numbers of shingles, repeats included, of all templates."""
    out = set()
    for wording in (w for texts in templates.values() for w in texts):
        data, offsets = utf8(pa.array([wording]))
        n = len(words(LOWER[data], offsets, PARTING)[0])
        out |= {n - min(SHINGLE, n) + 1} if n else set()
    return out


class Signer:
    """MinHash values over windows of several sizes at once."""

    def __init__(self, count: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.times = rng.integers(1, 2**63, count, dtype=np.uint64) * U64(2) + U64(1)
        self.plus = rng.integers(0, 2**64, count, dtype=np.uint64)

    def of_set(self, shingles: np.ndarray) -> np.ndarray:
        return np.array([(shingles * t + p).min() for t, p in zip(self.times, self.plus)], np.uint64)

    def of_windows(self, hashed: np.ndarray, real: np.ndarray, ends: np.ndarray, sizes: dict[int, np.ndarray | slice]):
        """For each function, the minima over the windows of each size that begin at given places; a text's end cuts windows off."""
        n, longest = len(hashed), max(sizes)
        place, none = np.arange(n), ~real
        # Whether the place some steps on belongs to the same text.
        inside = lambda by: place[by:] < ends[: max(0, n - by)]
        doubled, halves, length = [], {}, 1
        while length <= longest:
            doubled.append((length, inside(length)))
            if length > 1 and length * 3 // 2 in sizes:
                # Two stretches of ``length`` make up the window.
                halves[length] = inside(length // 2)
            length *= 2
        for t, p in zip(self.times, self.plus):
            level = hashed * t
            level += p
            level[none] = U64(2**64 - 1)
            out = {}
            for length, same in doubled:
                if length in sizes:
                    out[length] = level[sizes[length]].copy()
                if length in halves:
                    half, size = length // 2, length * 3 // 2
                    whole = level.copy()
                    np.minimum(level[: len(halves[length])], level[half:], out=whole[: len(halves[length])], where=halves[length])
                    out[size] = whole[sizes[size]]
                if 2 * length > longest:
                    break
                grown = level.copy()
                np.minimum(level[: len(same)], level[length:], out=grown[: len(same)], where=same)
                level = grown
            yield out


def _key(value: np.ndarray, band: int) -> np.ndarray:
    return (value ^ U64((band + 1) * 0xD6E8FEB86659FD93 % 2**64)) * U64(GOLD)


@dataclass
class Table:
    """The templates of one shingle and window size: sorted band keys, whose template each is, and a filter by the keys' first bits."""

    keys: np.ndarray
    owner: np.ndarray
    known: np.ndarray
    step: int

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``keys``, template) of each key that a template has too."""
        # The first 16 bits of each key are every fourth of its pieces.
        maybe = np.flatnonzero(self.known.take(keys.astype("<u8", copy=False).view("<u2")[3::4]))
        lo, hi = (np.searchsorted(self.keys, keys[maybe], side) for side in ("left", "right"))
        count = hi - lo
        return np.repeat(maybe, count), self.owner[np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]


def tables_of(known: list[_Template], signer: Signer, rows: int) -> dict[tuple[int, int], Table]:
    out = {}
    for kind in sorted({(t.words, t.window) for t in known}):
        own = [i for i, t in enumerate(known) if (t.words, t.window) == kind]
        signs = [signer.of_set(known[i].shingles) for i in own]
        keys = np.concatenate([_banded(s, rows) for s in signs])
        owner = np.repeat(own, len(signer.times) // rows)
        by = np.argsort(keys, kind="stable")
        first = np.zeros(1 << 16, bool)
        first[keys >> U64(48)] = True
        out[kind] = Table(keys[by], owner[by], first, known[own[0]].step)
    return out


def _banded(sign: np.ndarray, rows: int) -> np.ndarray:
    """The band keys of one signature."""
    keys = np.zeros(len(sign) // rows, np.uint64)
    for i in range(len(keys) * rows):
        keys[i // rows] = keys[i // rows] * U64(GOLD) + sign[i]
    return np.array([_key(k[None], band)[0] for band, k in enumerate(keys)], np.uint64)


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, containment: float = 0.8, probability: float = 0.9999, rows: int = 1) -> DataFrame:
    """``docs`` with ``n_words`` and ``licenses``: for each stretch that matches a template its name, first word, end and containment.

    Words are runs of digits, letters and non-ASCII characters, A-Z lowered; shingles have five words (shorter templates: all of
    theirs). A window matches if it holds at least ``containment`` of a template's different shingles. Windows overlap so that one
    holds any stretch of the template's length whole; its Jaccard similarity is then ``SIMILARITY`` at least, where the bands
    collide with ``probability``. Overlapping matches of a license are one, with the best window's figures, the first of equals.
    Null and empty texts match nothing; repeated rows stay; columns of ``docs`` named n_words or licenses are replaced; an empty
    table gives no rows. Templates without words are passed over.
    """
    docs = docs.drop("n_words", "licenses")
    names = docs.columns
    known = [t for name, texts in templates.items() for text in texts if (t := template(name, text))]
    signer = Signer(bands(SIMILARITY, probability, rows) * rows)
    tables = tables_of(known, signer, rows)

    def candidates(hashed: np.ndarray, bounds: np.ndarray, size: int) -> dict[int, np.ndarray]:
        """For each template of one shingle size the starts of the windows that share a band with it."""
        own = {window: table for (n, window), table in tables.items() if n == size}
        counts = np.diff(bounds)
        ends = np.repeat(bounds[1:], counts)
        # The place behind a text's last shingle ends its windows.
        stop = np.repeat(bounds[1:] - np.minimum(size - 1, counts), counts)
        real = np.arange(len(hashed)) < stop
        inner = np.arange(len(hashed)) - np.repeat(bounds[:-1], counts)
        starts = {window: np.flatnonzero((inner % table.step == 0) & real) if table.step > 1 else np.arange(len(hashed)) for window, table in own.items()}
        places = {window: at if own[window].step > 1 else slice(None) for window, at in starts.items()}
        found: dict[int, list[np.ndarray]] = {}
        partial = {window: np.zeros(len(at), np.uint64) for window, at in starts.items()}
        for i, least in enumerate(signer.of_windows(hashed, real, ends, places)):
            for window, values in least.items():
                partial[window] = partial[window] * U64(GOLD) + values if rows > 1 else values
                if i % rows == rows - 1:
                    at, which = own[window].look_up(_key(partial[window], i // rows))
                    partial[window] = np.zeros(len(starts[window]), np.uint64) if rows > 1 else values
                    for t in np.unique(which):
                        found.setdefault(int(t), []).append(starts[window][at[which == t]])
        # Where no shingle begins, the largest value stands; it is nobody's minimum.
        return {t: at[real[at]] for t, x in found.items() for at in [np.unique(np.concatenate(x))]}

    def verified(hashed: np.ndarray, bounds: np.ndarray, t: _Template, starts: np.ndarray):
        """(start, end, containment) of the windows that hold enough of a template, ascending."""
        text = np.searchsorted(bounds, starts, "right") - 1
        for a, end in zip(starts.tolist(), bounds[text + 1].tolist()):
            last = min(a + t.window, end - t.words + 1)
            share = len(np.intersect1d(hashed[a:last], t.shingles)) / len(t.shingles)
            if share >= containment:
                yield a, min(a + t.window + t.words - 1, end), share

    def each(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(names.index(text_col)))
            n_words, found = [], [[] for _ in range(batch.num_rows)]
            for i, j in slices(offsets, SLICE):
                part = LOWER[data[offsets[i] : offsets[j]]]
                starts, stops, bounds = words(part, offsets[i : j + 1] - offsets[i], PARTING)
                codes = word_hashes(part, starts, stops)
                n_words += np.diff(bounds).tolist()
                if not len(codes):
                    continue
                matches: dict[str, list] = {}
                for size in sorted({t.words for t in known}):
                    hashed = mix(rolling(codes, size))
                    for t, at in candidates(hashed, bounds, size).items():
                        matches.setdefault(known[t].name, []).extend(verified(hashed, bounds, known[t], at))
                for name in (n for n in templates if n in matches):
                    for a, b, share in sorted(matches[name]):
                        doc = int(np.searchsorted(bounds, a, "right")) - 1
                        a, b = a - int(bounds[doc]), b - int(bounds[doc])
                        own = found[i + doc]
                        if own and own[-1]["license"] == name and a < own[-1]["until"]:
                            own[-1]["until"] = max(own[-1]["until"], b)
                            if share > own[-1]["containment"]:
                                own[-1] |= {"start": a, "end": b, "containment": share}
                        else:
                            own.append({"license": name, "start": a, "end": b, "containment": share, "until": b})
            kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))
            lists = [[{k: v for k, v in m.items() if k != "until"} for m in ms] for ms in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(lists, kind)], names=[*names, "n_words", "licenses"])

    return docs.mapInArrow(each, extended(docs, f"n_words long, licenses {MATCH}"))
