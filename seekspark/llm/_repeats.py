"""The frame in which repeats are found across a whole corpus.

Rows fall into chunks by a hash of identity and text, one chunk a partition. One
exchange of the texts serves three passes over the chunks; between the passes only
compact columns of hashes (or short byte segments) travel:

1. each chunk lists the distinct hashes of its *anchors*. An anchor is the least
   hash of the short grams in a window, so equal windows have equal anchors and
   a window without a repeated anchor cannot repeat;
2. buckets of hashes say which anchors some other place has too;
3. each chunk takes the windows with such an anchor, settles what it can by itself
   and sends one *entry* for each distinct content to the bucket of that content;
4. the entries of all chunks are compared;
5. each chunk applies the answers.

A chunk sends a content once, however many of its rows hold it, so a passage in a
third of all rows costs a bucket one entry for each chunk. What a chunk sends to a
bucket is one row, so there are no more of them than blocks in a Spark shuffle of
as many partitions, and never more than anchors. Chunks and buckets follow
``spark.sql.shuffle.partitions``, which is set in proportion to the input. A chunk
is worked on in blocks of ``BLOCK`` bytes. Everything is recomputed alike if an
executor is lost: chunks sort their rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from seekspark.llm._arrow import U64, mix, sliding, slices, trailing, utf8
from seekspark.llm._shared import partitions

TOP = U64(2**64 - 1)
#: Bytes of text whose windows are hashed at once.
BLOCK = 512 << 10
#: What passes send each other. Kind 1 is an entry, kind 2 what a chunk keeps for its last pass.
MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def buckets_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The bucket, of n, of each hash; it grows with the hash."""
    return (((hashes >> U64(40)) * U64(n)) >> U64(24)).astype(np.int64)


def keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions an integer that Spark's hash puts there, so that as many groups lie one in each."""
    found = spark.range(32 * n + 1024).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()
    out = np.full(n, -1, np.int64)
    for r in found:
        out[r["p"]] = r["k"]
    # A partition without one, if any, is skipped by taking a number of its own, wherever that falls.
    out[out < 0] = 33 * n + 1024 + np.flatnonzero(out < 0)
    return out


def again(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ U64(0x5851F42D4C957F2D))


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length as bytes, planes of equal significance together, so that block compression removes the high ones."""
    n = len(arrays[0])
    return np.int64(n).tobytes() + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(n, a.itemsize).T.tobytes() for a in arrays) if n else np.int64(0).tobytes()


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at if n else 0).reshape(size, n).T).view(kind).reshape(n) if n else np.zeros(0, kind))
        at += n * size
    return out


def rows(bucket, chunk, kind, data) -> pa.Table:
    return pa.table([pa.array(bucket, pa.int32()), pa.array(chunk, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], schema=MESSAGE)


def split_by_bucket(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """For ascending buckets, each one with the slice of its entries."""
    if not len(bucket):
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    return [(int(bucket[a]), slice(int(a), int(b))) for a, b in zip(cut[:-1], cut[1:])]


class Anchors:
    """Grams of ``k`` codes over which windows of ``k + w - 1`` codes are told apart. ``bounds``: where each text begins."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, k: int, w: int):
        n = len(hashes)
        ends = np.repeat(bounds[1:], np.diff(bounds))
        fits = np.arange(n) + k <= ends
        self.h = np.where(fits, hashes, TOP)
        self.w, self.valid = w, np.arange(n) + k + w - 1 <= ends
        self.least = sliding(self.h, w)
        self.at = np.flatnonzero((trailing(np.where(self.valid, self.least, U64(0)), w) == self.h) & fits)
        # Least hashes crowd at the low end; hashed again they fall evenly into buckets.
        self.unique, self.index, count = np.unique(again(self.h[self.at]), return_inverse=True, return_counts=True)
        self.twice = count > 1

    def candidates(self, elsewhere: np.ndarray) -> np.ndarray:
        """Windows whose least gram occurs twice here or elsewhere too."""
        known = np.full(len(self.h), TOP)
        at = self.at[(self.twice | elsewhere)[self.index]]
        known[at] = self.h[at]
        return self.valid & (sliding(known, self.w) == self.least)


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("id", "ascending"), ("text", "ascending")])


def blocks(table: pa.Table, block: int = BLOCK):
    """Slices of a table with about ``block`` bytes of text each, one row at least, with their first row."""
    _, offsets = utf8(table.column("text"))
    for i, j in slices(offsets, block):
        yield i, table.slice(i, j - i)


def common_grams(docs: DataFrame, text_col: str, hashes, sample: int, held_by: int, most: int = 1 << 20) -> np.ndarray:
    """Hashes, ascending, of grams that ``held_by`` or more of about ``sample`` rows have, drawn over the whole table; of more than ``most`` the most frequent.

    ``hashes(data, offsets) -> (hash of the gram at each byte, whether it ends inside its text)``. At most ``8 * most`` bytes come to the
    driver. Anchors had better be other grams: one that stands in many texts brings all its surroundings to one bucket.
    """
    rows_in = docs.count()
    drawn = docs.select(F.col(text_col).cast("string").alias("text")).sample(min(1.0, sample / max(rows_in, 1)), seed=1).repartition(4)

    def each(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slices(offsets, 4 * BLOCK):
                own = offsets[i : j + 1] - offsets[i]
                h, fits = hashes(data[offsets[i] : offsets[j]], own)
                text = np.repeat(np.arange(j - i), np.diff(own))[fits]
                h = h[fits]
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                found, count = np.unique(h[new], return_counts=True)
                often = count > 1
                yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(count[often])], names=["h", "n"])

    got = drawn.mapInArrow(each, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= held_by).orderBy(F.desc("n"), "h").limit(most).select("h").collect()
    return np.sort(np.array([r["h"] for r in got], np.int64).view(np.uint64))


def merged(docs: DataFrame) -> DataFrame:
    """(id, text, copies) with the equal rows of each batch as one: however often a row is repeated, few of it travel."""

    def each(batches):
        for batch in batches:
            table = pa.table({"id": batch.column(0), "text": batch.column(1).cast(pa.large_string())}).group_by(["id", "text"], use_threads=False).aggregate([([], "count_all")])
            out = table.rename_columns(["id", "text", "copies"])
            yield from pa.table({"id": out.column(0), "text": out.column(1).cast(pa.string()), "copies": out.column(2)}).to_batches()

    return docs.mapInArrow(each, "id long, text string, copies long")


def find(docs: DataFrame, id_col: str, text_col: str, anchors, entries, settle, finish, schema: str, entry: pa.Schema = MESSAGE, n_parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """Run the passes.

    ``anchors(block) -> Anchors``; ``entries(table, each, n) -> (state, buckets, columns)``, where ``each`` yields for each block its
    first row, itself, its anchors and the candidate windows; ``settle(made) -> answers``: from entries
    and states, rows of ``entry``, to answers by column ``chunk``, states among them; ``finish(table, answers) -> table`` of
    ``schema``, a row for each of the chunk's; answers stand by bucket.

    Null ids and texts come to the functions as they are; equal rows come once and leave as often as they were; an empty table has
    no chunks and gives no rows.
    """
    spark = docs.sparkSession
    n = n_parts or partitions(spark)
    names = keys(spark, n).tolist()
    own = F.split(F.lit(",".join(map(str, names))), ",").cast("array<int>")  # one constant
    texts = merged(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")))
    chunked = texts.select(F.element_at(own, F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int") + 1).alias("chunk"), "id", "text", "copies").repartition(n, "chunk")

    def list_anchors(table: pa.Table) -> pa.Table:
        chunk, out = table.column("chunk")[0].as_py(), {}
        for _, part in blocks(in_order(table), block):
            found = anchors(part)
            planes = found.unique.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T
            for b, s in split_by_bucket(buckets_of(found.unique, n)):
                out.setdefault(b, []).append(planes[:, s])
        made = {b: np.concatenate(parts, axis=1).tobytes() for b, parts in out.items()}
        return rows([names[b] for b in made], [chunk] * len(made), list(made), list(made.values()))

    def match_anchors(table: pa.Table) -> pa.Table:
        data = [np.frombuffer(x, np.uint8).reshape(5, -1) for x in table.column("data").to_pylist()]
        sizes = np.array([x.shape[1] for x in data])
        wide = np.zeros((int(sizes.sum()), 8), np.uint8)
        wide[:, :5] = np.concatenate(data, axis=1).T
        low = wide.view("<u8").reshape(-1)
        order = np.argsort(low)
        same = low[order][1:] == low[order][:-1]
        found = np.zeros(len(low), bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        ends = np.cumsum(sizes)
        return rows(table.column("bucket"), table.column("chunk"), table.column("kind"), [np.packbits(found[e - s : e]).tobytes() + np.int64(s).tobytes() for s, e in zip(sizes, ends)])

    def make_entries(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return entry.empty_table()
        chunk, table = table.column("chunk")[0].as_py(), in_order(table)
        bits = {}
        for b, x in zip(answers.column("kind").to_pylist(), answers.column("data").to_pylist()):
            size = int(np.frombuffer(x, np.int64, 1, len(x) - 8)[0])
            bits[b] = np.unpackbits(np.frombuffer(x, np.uint8, len(x) - 8))[:size].astype(bool)
        done = dict.fromkeys(bits, 0)

        def each():
            for first, part in blocks(table, block):
                found = anchors(part)
                elsewhere = np.zeros(len(found.unique), bool)
                for b, s in split_by_bucket(buckets_of(found.unique, n)):
                    elsewhere[s] = bits[b][done[b] : done[b] + s.stop - s.start]
                    done[b] += s.stop - s.start
                yield first, part, found, found.candidates(elsewhere)

        state, bucket, columns = entries(table, each(), n)
        k = len(bucket)
        sent = pa.table({"bucket": pa.array([names[b] for b in bucket], pa.int32()), "chunk": pa.array([chunk] * k, pa.int32()), "kind": pa.array([1] * k, pa.int32()), **columns})
        both = pa.concat_tables([sent, rows([chunk], [chunk], [2], [state])], promote_options="default")
        return both.select(entry.names).cast(entry)

    def apply_answers(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_order(table)
        if "bucket" in answers.column_names:
            place = {name: i for i, name in enumerate(names)}
            answers = answers.take(pa.array(np.argsort([place[x] for x in answers.column("bucket").to_pylist()], kind="stable").astype(np.int64)))
        out, copies = finish(table, answers), table.column("copies").to_numpy()
        return out.take(pa.array(np.repeat(np.arange(len(copies)), copies))) if len(copies) and copies.max() > 1 else out

    listed = chunked.groupBy("chunk").applyInArrow(list_anchors, from_arrow_schema(MESSAGE))
    matched = listed.groupBy("bucket").applyInArrow(match_anchors, from_arrow_schema(MESSAGE))
    made = chunked.groupBy("chunk").cogroup(matched.groupBy("chunk")).applyInArrow(make_entries, from_arrow_schema(entry))
    return chunked.groupBy("chunk").cogroup(settle(made).groupBy("chunk")).applyInArrow(apply_answers, schema)
