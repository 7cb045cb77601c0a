"""Operator 2, byte-level deduplication with suffix arrays.

Stretches that may repeat are cut where the least gram of their windows changes,
so equal windows meet in the bucket of that gram. A bucket sorts the suffixes of
its different stretches in two stages and takes adjacent common prefixes; suffixes
that share ``length`` bytes form a run, whose least document keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seekspark.llm import _repeats
from seekspark.llm._arrow import BYTE_CODES, int64, mix, rolling, run_ends, utf8
from seekspark.llm.suffix_array import common_prefixes, suffix_array

SCHEMA = "id long, n_bytes long, n_removed long, spans array<struct<start: int, end: int>>, kept binary"
#: Windows in a stretch, at most: what bounds the sorting of periodic texts.
STRETCH = 256
#: Bytes of a bucket's stretches that are sorted together, about; the stretches of one gram stay together.
SORT_BYTES = 512 << 10
STAYS, GOES, ASKS = 0, 1, 2


def repeated_windows(texts: list[bytes], ids: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each text the spans of bytes that lie in a ``length``-byte string which a text with a smaller id has too."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    sizes = np.array([len(x) + 1 for x in texts])
    starts = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 1
    symbols[starts + sizes - 1] = 0
    order = suffix_array(symbols)
    shared = common_prefixes(symbols, order, length)
    owner = np.repeat(np.arange(len(texts)), sizes)
    long_enough = (starts[owner] + sizes[owner] - 1 - np.arange(len(symbols))) >= length
    run = np.cumsum(shared < length) - 1
    least = np.minimum.reduceat(ids[owner[order]], np.flatnonzero(shared < length))[run]
    hit = np.zeros(len(symbols), bool)
    hit[order] = (least < ids[owner[order]]) & long_enough[order]
    for a, b in zip(*run_ends(hit)):
        k = int(owner[a])
        out[k].append((int(a - starts[k]), int(b - starts[k]) + length - 1))
    return out


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int | None = None, n_parts: int | None = None, block: int = _repeats.BLOCK, sample: int = 4000, held_by: int = 8) -> DataFrame:
    """One row for each row of ``docs``: its id, how many bytes its UTF-8 text has and loses, the removed spans, and the bytes kept.

    A byte goes if a string of ``length`` bytes over it also starts in a row with a smaller id. Strings never cross rows and are
    judged on the input. A null text counts as empty; shorter texts stay whole. Rows with one id take nothing from each other, nor
    does a row from itself. A null id ranks behind all others. Other columns are not read. An empty table gives no rows.

    ``gram``: length of the anchors by which strings are preselected; ``block``: bytes hashed at once. Grams that
    ``held_by`` of about ``sample`` rows have are anchors only of strings that have no other gram, so that the bucket of a frequent
    phrase doesn't fill with all that stands around it. These change cost, never results.
    """
    k = gram or max(1, (length * 2) // 5)
    w = length - k + 1

    def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return mix(rolling(BYTE_CODES[0][data], k)), np.arange(len(data)) + k <= np.repeat(offsets[1:], np.diff(offsets))

    common = _repeats.common_grams(docs, text_col, grams, sample, held_by) if sample else np.zeros(0, np.uint64)
    maybe = np.zeros(1 << 20, bool)
    maybe[common >> np.uint64(44)] = True
    sent = docs.sparkSession.sparkContext.broadcast((common, np.packbits(maybe)))

    def anchors(block: pa.Table) -> _repeats.Anchors:
        data, offsets = utf8(block.column("text"))
        h, known, bits = grams(data, offsets)[0], sent.value[0], np.unpackbits(sent.value[1]).view(bool)
        rank = h >> np.uint64(1)
        if len(known):
            at = np.flatnonzero(bits[h >> np.uint64(44)])
            at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]
            rank[at] |= np.uint64(1 << 63)
        return _repeats.Anchors(rank, offsets, k, w)

    def stretches(data: np.ndarray, found: _repeats.Anchors, candidates: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, hash of the least gram) of the stretches of a block's candidate windows: one least gram each, and at most ``STRETCH`` windows."""
        starts, ends = run_ends(candidates)
        first = np.zeros(len(data) + 1, bool)
        first[:-1] = candidates
        first[1:-1] &= ~candidates[:-1] | (found.least[1:] != found.least[:-1])
        at = np.flatnonzero(first)
        stop = np.minimum(np.append(at[1:], len(data)), ends[np.searchsorted(starts, at, "right") - 1]) if len(at) else at
        pieces = -(-(stop - at) // STRETCH)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(at, pieces) + nth * STRETCH
        return start, np.minimum(start + STRETCH, np.repeat(stop, pieces)) + length - 1, _repeats.again(found.least[start])

    def entries(table, each, n):
        data, offsets = utf8(table.column("text"))
        parts = [(*(x + offsets[first] for x in (start, end)), key) for first, part, found, candidates in each for start, end, key in [stretches(utf8(part.column("text"))[0], found, candidates)]]
        start, end, key = (np.concatenate(x) for x in zip(*parts))
        row = np.searchsorted(offsets, start, "right") - 1
        ids = int64(table.column("id"))[row]
        raw, seen = data.tobytes(), {}
        note = seen.setdefault
        ref = np.array([note(raw[a:b], i) for i, (a, b) in enumerate(zip(start.tolist(), end.tolist()))], np.int64)
        gone = ids[ref] < ids
        sent = np.flatnonzero(ref == np.arange(len(ref)))
        bucket = _repeats.buckets_of(key[sent], n)
        by = np.argsort(bucket, kind="stable")
        sent, bucket = sent[by], bucket[by]
        place = np.zeros(len(ref), np.uint32)
        place[sent] = np.arange(len(sent), dtype=np.uint32)
        state = _repeats.pack(np.diff(start, prepend=0).astype(np.uint32), (end - start).astype(np.uint32), gone.astype(np.uint8), place[ref])
        size = (end - start).astype(np.uint32)
        a, b = start.tolist(), end.tolist()
        split = _repeats.split_by_bucket(bucket)
        made = [_repeats.pack(size[sent[s]], ids[sent[s]], key[sent[s]].astype(np.uint32)) + b"".join(raw[a[i] : b[i]] for i in sent[s].tolist()) for _, s in split]
        return state, [x for x, _ in split], {"data": pa.array(made, pa.binary())}

    def compare(data):
        parts = [_repeats.unpack(x, np.uint32, np.int64, np.uint32) for x in data]
        counts = [len(size) for size, _, _ in parts]
        size, ids, grams = (np.concatenate(x) for x in zip(*parts))
        of = np.repeat(np.arange(len(data)), counts).tolist()
        closes = np.concatenate([8 + len(n) * 16 + np.cumsum(n, dtype=np.int64) for n, _, _ in parts])
        opens, closes = (closes - size).tolist(), closes.tolist()
        what, asked = np.zeros(len(ids), np.uint8), {}
        # Grams by gram, in lots that stay in the processor's cache.
        order = np.argsort(grams, kind="stable")
        upto = np.cumsum(size[order], dtype=np.int64)
        last = np.append(np.flatnonzero(np.diff(grams[order])) + 1, len(order))
        begin = 0
        while begin < len(order):
            stop = int(last[min(np.searchsorted(upto[last - 1], (upto[begin - 1] if begin else 0) + SORT_BYTES), len(last) - 1)])
            own = order[begin:stop]
            begin = stop
            texts = [data[of[i]][opens[i] : closes[i]] for i in own.tolist()]
            seen: dict[bytes, int] = {}
            note = seen.setdefault
            ref = np.array([note(x, i) for i, x in enumerate(texts)], np.int64)
            least = np.full(len(ref), 2**63 - 1)
            np.minimum.at(least, ref, ids[own])
            what[own] = np.where(ids[own] > least[ref], GOES, STAYS)
            # Of the different stretches, those of a gram that has several are sorted.
            alone = np.flatnonzero(ref == np.arange(len(ref)))
            same = grams[own][alone]
            several = np.zeros(len(alone), bool)
            several[1:] = same[1:] == same[:-1]
            several[:-1] |= same[:-1] == same[1:]
            picked = alone[several]
            if len(picked):
                spans = {i: x for i, x in zip(picked.tolist(), repeated_windows([texts[i] for i in picked], least[picked], length)) if x}
                asks = np.flatnonzero(np.isin(ref, np.fromiter(spans, np.int64, len(spans))) & (what[own] == STAYS))
                what[own[asks]] = ASKS
                asked |= {int(own[i]): spans[int(ref[i])] for i in asks.tolist()}
        out, at = [], 0
        for n in counts:
            part = [(i - at, a, b) for i in (at + np.flatnonzero(what[at : at + n] == ASKS)).tolist() for a, b in asked[i]]
            out.append(_repeats.pack(what[at : at + n]) + _repeats.pack(*(np.array(x, np.uint32) for x in (zip(*part) if part else [[]] * 3))))
            at += n
        return out

    def match_entries(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "ascending"), ("chunk", "ascending")])
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        n = kinds.count(1)
        return _repeats.rows(table.column("bucket"), table.column("chunk"), table.column("kind"), (compare(data[:n]) if n else []) + data[n:])

    def settle(made: DataFrame) -> DataFrame:
        return made.groupBy("bucket").applyInArrow(match_entries, made.schema)

    def verdicts(state: bytes, answers: list[bytes]):
        """(start, end) of all removed spans of a chunk, in bytes from its first."""
        step, size, gone, place = _repeats.unpack(state, np.uint32, np.uint32, np.uint8, np.uint32)
        start = np.cumsum(step, dtype=np.int64)
        what, who, where = [], [[], [], []], 0
        for x in answers:
            said = _repeats.unpack(x, np.uint8)[0]
            more = _repeats.unpack(x[8 + len(said) :], np.uint32, np.uint32, np.uint32)
            for to, part in zip(who, (more[0].astype(np.int64) + where, *more[1:])):
                to.append(part.astype(np.int64))
            what.append(said)
            where += len(said)
        what = np.concatenate(what) if what else np.zeros(0, np.uint8)
        verdict = np.where(gone == 1, GOES, what[place]) if len(place) else gone
        whole = verdict == GOES
        opens, closes = [start[whole]], [start[whole] + size[whole]]
        if where and sum(map(len, who[0])):
            entry, a, b = (np.concatenate(x) for x in who)
            asks = np.flatnonzero(verdict == ASKS)
            lo, hi = np.searchsorted(entry, place[asks]), np.searchsorted(entry, place[asks], "right")
            take = np.repeat(lo, hi - lo) + np.arange(int((hi - lo).sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            base = np.repeat(start[asks], hi - lo)
            opens.append(base + a[take])
            closes.append(base + b[take])
        return np.concatenate(opens), np.concatenate(closes)

    def finish(table, answers):
        said = list(zip(answers.column("kind").to_pylist(), answers.column("data").to_pylist()))
        state = next((x for kind, x in said if kind == 2), None)
        opens, closes = verdicts(state, [x for kind, x in said if kind == 1]) if state else (np.zeros(0, np.int64),) * 2
        by = np.argsort(opens, kind="stable")
        opens, closes = opens[by], closes[by]
        out, begin = [], 0
        for _, part in _repeats.blocks(table, block):
            data, offsets = utf8(part.column("text"))
            i, j = np.searchsorted(opens, [begin, begin + len(data)])
            depth = np.bincount(opens[i:j] - begin, minlength=len(data) + 1) - np.bincount(closes[i:j] - begin, minlength=len(data) + 1)
            out.append(shown(part, data, offsets, np.cumsum(depth[: len(data)]) > 0))
            begin += len(data)
        return pa.concat_tables(out) if out else shown(table, np.zeros(0, np.uint8), np.zeros(table.num_rows + 1, np.int64), np.zeros(0, bool))

    def shown(block: pa.Table, data: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> pa.Table:
        kept = data[~removed]
        bounds = np.concatenate([[0], np.cumsum(~removed)])[offsets]
        lost = np.diff(offsets) - np.diff(bounds)
        spans = [[{"start": int(a), "end": int(b)} for a, b in zip(*run_ends(removed[i:j]))] if x else [] for i, j, x in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lost.tolist())]
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())]).cast(pa.binary())
        return pa.table({"id": block.column("id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(lost), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept": whole})

    return _repeats.find(docs, id_col, text_col, anchors, entries, settle, finish, SCHEMA, n_parts=n_parts, block=block)
