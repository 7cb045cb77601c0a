"""Operator 10, substring deduplication over words.

Rabin-Karp hashes of every window of ``window`` words are compared across the
corpus; repeated windows merge into maximal intervals, which are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seekspark.llm import _repeats
from seekspark.llm._arrow import SPACES, covered, int64, mix, rolling, run_ends, utf8, word_hashes, words
from seekspark.llm._shared import partitions

SCHEMA = "id long, n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept_text string"
NONE = np.uint32(2**32 - 1)
WINDOW = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("place", pa.int32())])
ENTRY = pa.schema([*_repeats.MESSAGE, pa.field("windows", pa.list_(WINDOW))])
OUT = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())]


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int | None = None, n_parts: int | None = None, block: int = _repeats.BLOCK) -> DataFrame:
    """One row for each row of ``docs``: its id, how many words it has and loses, the spans of words removed, and the kept words joined by one space.

    Words are runs without space or the controls 9 to 13. A word goes if a window over it has the words of a window that starts
    earlier: in a row with a smaller id, or before it in the same row. Windows are judged on the input. A null text has no words;
    texts under ``window`` words stay whole. Rows with one id count as documents of equal rank: neither takes words from the other.
    A null id ranks behind all others. Other columns are not read. An empty table gives no rows.

    ``gram``: length of the anchors by which windows are preselected (half a window, by default); ``block``: bytes
    hashed at once. These change cost, never results.
    """
    k = gram or max(1, window // 2)
    w = window - k + 1

    def parse(table: pa.Table):
        data, offsets = utf8(table.column("text"))
        return data, words(data, offsets, SPACES)

    def anchors(block: pa.Table) -> _repeats.Anchors:
        data, (starts, ends, bounds) = parse(block)
        return _repeats.Anchors(mix(rolling(word_hashes(data, starts, ends), k)), bounds, k, w)

    def entries(table, each, n):
        ids, parts, before = int64(table.column("id")), [], 0
        for first, block, _, candidates in each:
            data, (starts, ends, bounds) = parse(block)
            at = np.flatnonzero(candidates)
            lanes = [mix(rolling(word_hashes(data, starts, ends, lane), window, lane))[at] for lane in (0, 1)]
            parts.append((at + before, first + np.searchsorted(bounds, at, "right") - 1, *lanes))
            before += len(starts)
        at, doc, *lanes = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((lanes[1], lanes[0]))
        a, b = lanes[0][order], lanes[1][order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        again = np.zeros(len(order), bool)
        again[1:] = ~new[1:] & (doc[order][1:] == doc[order][:-1])
        ref, gone = np.empty_like(order), np.empty(len(order), bool)
        ref[order], gone[order] = first, again | (ids[doc][order] > ids[doc][first])
        sent = np.flatnonzero(ref == np.arange(len(ref)))
        bucket = _repeats.buckets_of(lanes[0][sent], n)
        by = np.argsort(bucket, kind="stable")
        sent, bucket = sent[by], bucket[by]
        place = np.full(len(at), NONE, np.uint32)
        place[sent] = np.arange(len(sent), dtype=np.uint32)
        state = _repeats.pack(np.diff(at, prepend=0).astype(np.uint32), np.where(gone, NONE, place[ref]))
        split = _repeats.split_by_bucket(bucket)
        flat = pa.StructArray.from_arrays([pa.array(lanes[0][sent].view(np.int64)), pa.array(lanes[1][sent].view(np.int64)), pa.array(ids[doc][sent]), pa.array(np.arange(len(sent), dtype=np.int32))], fields=list(WINDOW))
        bounds = np.array([0, *(s.stop for _, s in split)], np.int32)
        return state, [x for x, _ in split], {"windows": pa.ListArray.from_arrays(pa.array(bounds), flat)}

    def settle(made: DataFrame) -> DataFrame:
        """Windows compared over all chunks, each of which sends one of a kind: (chunk, place) of those that have an earlier equal, and the chunks' states."""
        made = made.repartition(n_parts or partitions(made.sparkSession), "bucket")
        sent = made.select("bucket", "chunk", "kind", "data", F.explode_outer("windows").alias("w")).select("bucket", "chunk", "kind", "data", "w.*")
        counted = sent.withColumn("least", F.min("id").over(Window.partitionBy("bucket", "a", "b")))
        return counted.filter("kind = 2 OR id > least").select("chunk", "kind", "place", "data")

    def finish(table, answers):
        kinds = answers.column("kind").to_numpy()
        gone, begin, out = np.zeros(0, np.int64), 0, []
        if (kinds == 2).any():
            step, place = _repeats.unpack(answers.filter(pa.array(kinds == 2)).column("data")[0].as_py(), np.uint32, np.uint32)
            said = np.zeros(len(place) + 1, bool)
            said[answers.filter(pa.array(kinds == 1)).column("place").to_numpy()] = True
            said[-1] = True
            gone = np.cumsum(step, dtype=np.int64)[said[np.minimum(place, len(place))]]
        for _, part in _repeats.blocks(table, block):
            data, (starts, ends, bounds) = parse(part)
            i, j = np.searchsorted(gone, [begin, begin + len(starts)])
            out.append(shown(part, data, starts, ends, bounds, covered(len(starts), gone[i:j] - begin, window)))
            begin += len(starts)
        return pa.concat_tables(out) if out else pa.table({f: pa.array([], t) for f, t in OUT})

    def shown(block, data, starts, ends, bounds, gone) -> pa.Table:
        raw, out = data.tobytes(), []
        at, to, keep = starts.tolist(), ends.tolist(), ~gone
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            kept = np.flatnonzero(keep[i:j]) + i
            text = b" ".join(raw[at[x] : to[x]] for x in kept.tolist()) if len(kept) < j - i else b" ".join(raw[at[i] : to[j - 1]].split()) if j > i else b""
            out.append((j - i, j - i - len(kept), [{"start": int(a), "end": int(b)} for a, b in zip(*run_ends(gone[i:j]))] if len(kept) < j - i else [], text.decode()))
        cols = list(zip(*out)) or [[]] * 4
        return pa.table({f: block.column("id") if f == "id" else pa.array(c, t) for (f, t), c in zip(OUT, [None, *cols])})

    return _repeats.find(docs, id_col, text_col, anchors, entries, settle, finish, SCHEMA, ENTRY, n_parts, block)
