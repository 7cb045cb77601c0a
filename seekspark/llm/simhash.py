"""Operator 4, near-duplicates by SimHash and pivot distance tables.

Different fingerprints at ``most`` or fewer differing bits agree in several whole
blocks of bits, so they meet under one of the keys made of such blocks. Under a key,
a table of distances to reference fingerprints (pivots) discards every pair whose
largest coordinate difference exceeds ``most``; the survivors are compared bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seekspark.llm._arrow import utf8
from seekspark.llm._shared import durable
from seekspark.llm.components import components

#: Fingerprints under one key, on average, that the number of blocks is chosen for: the pivots' tables discard most of their pairs.
UNDER_A_KEY = 64
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 24, dtype=np.uint64)
#: Rows under one key that one comparison takes on each side; a larger key is split into tiles of about this many.
TILE = 2048


def fingerprint(text: bytes, size: int = 4) -> int:
    """A-Z lowered, words, ``size``-word shingles with repeats; a bit is 1 if set in over half of their XXH64 hashes of seed 42. Fewer words: one shingle of all; none: 0."""
    found = text.lower().split()
    if not found:
        return 0
    n = max(1, len(found) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    starts = np.concatenate([[0], ends[:-1] + 1])
    stops = ends[size - 1 :] if len(found) >= size else ends[-1:]
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), stops.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, text_hash) of each row; ``fp`` holds the 64 bits as a signed long. A null text counts as empty: fingerprint 0."""

    def each(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw = data.tobytes()
            fps = np.array([fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["id", "fp", "text_hash"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(each, "id long, fp long, text_hash long")


def blocks(n: int, most: int) -> list[int]:
    """Sizes of the blocks of bits for n fingerprints: as few as leave ``UNDER_A_KEY`` of them under a key of all blocks but ``most``.

    Fingerprints that differ in ``most`` bits agree in all blocks but as many, however the bits are cut, so the number changes cost
    alone: few blocks make few keys of each fingerprint, many make keys that tell more fingerprints apart.
    """
    for count in range(most + 1, 2 * most + 9):
        sizes = [64 // count + (i < 64 % count) for i in range(count)]
        if n / 2 ** sum(sizes[most:]) <= UNDER_A_KEY:
            break
    return sizes


def _keys(sizes: list[int], most: int):
    """Columns that hold the chosen blocks of ``fp``, with the number of the choice in front."""
    at, masks = 0, []
    for size in sizes:
        masks.append(((1 << size) - 1) << at)
        at += size
    for n, chosen in enumerate(combinations(masks, len(sizes) - most)):
        mask = sum(chosen)
        yield F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask).cast("long")).alias("bits"))


def pairs_within(fps: np.ndarray, keys: np.ndarray, sides: np.ndarray, most: int):
    """Pairs of indices under equal keys at ``most`` or fewer bits. ``keys`` ascends; sides: 0, 1, or 2 for rows that meet all."""
    table = np.stack([np.bitwise_count(fps ^ p).astype(np.int8) for p in PIVOTS], axis=1)
    order = np.lexsort((table[:, 0], keys))
    fps, keys, sides, table = fps[order], keys[order], sides[order], table[order]
    left, n = np.arange(len(fps)), len(fps)
    for apart in range(1, n):
        left = left[left + apart < n]
        right = left + apart
        # Under a key rows stand by their first coordinate: from where it is too far, all further ones are.
        left = left[(keys[left] == keys[right]) & (table[right, 0] - table[left, 0] <= most)]
        if not len(left):
            return
        right = left + apart
        near = left[(sides[left] == 2) | (sides[left] != sides[right])]
        for j in range(1, len(PIVOTS)):
            near = near[np.abs(table[near, j] - table[near + apart, j]) <= most]
        near = near[np.bitwise_count(fps[near] ^ fps[near + apart]) <= most]
        if len(near):
            yield order[near], order[near + apart]


class _Forest:
    """Union-find that tells which links join what was apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): links between the different fingerprints of the column ``fp`` at ``most`` or fewer bits, as many as keep every component whole.

    A null fingerprint links to nothing, repeated ones count once, and an empty table has no links. A key with more than ``TILE`` rows is split into tiles, and every two tiles of it meet in a group of their own, so no task
    holds more than two tiles of a key; each task keeps of its links those that join something.
    """
    distinct = fps.select("fp").filter("fp IS NOT NULL").distinct()
    sizes = blocks(distinct.count(), most)
    keyed = distinct.select("fp", F.explode(F.array(*_keys(sizes, most))).alias("k")).select("fp", "k.n", "k.bits")
    tiles = keyed.groupBy("n", "bits").agg(F.count("*").alias("rows")).filter(F.col("rows") > TILE).select("n", "bits", F.ceil(F.col("rows") / TILE).cast("int").alias("tiles"))
    split = keyed.join(tiles, ["n", "bits"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    plain = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("t"), F.lit(2).alias("side")))
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(own, t).alias("s"), F.greatest(own, t).alias("t"), F.when(own == t, 2).when(own < t, 0).otherwise(1).alias("side")))
    grouped = split.select("fp", "n", "bits", F.explode(F.when(F.col("tiles").isNull(), plain).otherwise(meets)).alias("m")).select(F.xxhash64("n", "bits", "m.s", "m.t").alias("key"), "fp", F.col("m.side").alias("side"))

    def compare(batches):
        forest, rest = _Forest(), None
        out: list[tuple[int, int]] = []

        def settle(key, fp, side):
            for i, j in pairs_within(fp.view(np.uint64), key, side, most):
                for a, b in zip(fp[i].tolist(), fp[j].tolist()):
                    if forest.join(a, b):
                        out.append((a, b))

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            settle(*(x[:cut] for x in now))
            rest = [x[cut:] for x in now]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
                out.clear()
        if rest is not None:
            settle(*rest)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return grouped.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def _rooted(docs: DataFrame, id_col: str, text_col: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp, text_hash) of each row of ``docs``, and (fp, least, root) of each fingerprint: its least id and the least fingerprint that links reach."""
    marked = durable(fingerprints(docs, id_col, text_col))
    nodes = durable(marked.groupBy("fp").agg(F.min("id").alias("least")))
    return marked, nodes.join(components(links(nodes, most)).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """(id, fp, text_hash, component) of each row of ``docs``: fingerprints at ``most`` or fewer bits are linked, ``component`` is the least id that links reach.

    Repeated rows stay repeated. Texts without words, null ones among them, have fingerprint 0 and are linked like any other. A
    null id takes part, but is least only where no row of the component has an id. Other columns are not read. An empty table
    gives no rows.
    """
    marked, rooted = _rooted(docs, id_col, text_col, most)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return marked.join(named, "fp").select("id", "fp", "text_hash", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """One row of ``docs`` for each component: that with the least id, then fingerprint, then text hash; columns as they are.

    A row without an id is kept only where no row of its component has one. An id that stands in several components, null too,
    may be kept in each. Of rows that are equal in id and text one is kept, the least by a hash of all columns. An empty table
    gives no rows. The texts travel once, to the list of what is kept.
    """
    marked, rooted = _rooted(docs, id_col, text_col, most)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "text_hash")).alias("f")
    kept = marked.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(first)
    # Equal texts share a component, so id and text hash tell the kept rows, and leave only copies of one row. Plain keys without nulls let both steps use one exchange.
    keys = ["__none", "__id", "__hash"]
    kept = kept.select(F.col("f.none").alias("__none"), F.coalesce("f.id", F.lit(0)).alias("__id"), F.col("f.text_hash").alias("__hash"))
    own = F.col(f"`{id_col}`").cast("long")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(own.isNull().alias("__none"), F.coalesce(own, F.lit(0)).alias("__id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("__hash"), row)
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row")))
    return rows.join(kept, keys, "left_semi").withColumn("copy", copy).filter("copy = 1").select("row.*")
