"""Operator 5, packing by optimal length buckets.

Dynamic programming over the histogram of all lengths sets the bucket boundaries with
the least padding; batches of a token budget form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seekspark.llm._shared import partitions, written

WORDS = r"coalesce(regexp_count(cast({text} AS string), '[^\\x20\\x09-\\x0D]++'), 0)"


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The greatest lengths of at most ``buckets`` buckets, ascending, that pad ``counts`` texts of ascending distinct ``lengths`` least in all.

    One layer of the dynamic programme for each bucket. The best cut before a length never moves back as the length grows, so a
    layer halves the range of cuts level by level: n log n steps, all lengths of a level at once.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    tokens = np.concatenate([[0], np.cumsum(counts.astype(np.float64) * lengths)])
    best = lengths * rows[1:] - tokens[1:]
    cuts = []
    for _ in range(min(buckets, n) - 1):
        now, cut = best.copy(), np.full(n, -1)
        # Stretches of lengths lo .. hi with their cuts among a .. b; the middle one divides both.
        lo, hi, a, b = (np.array([x]) for x in (1, n - 1, 0, n - 2))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(b, j - 1) - a + 1
            start = np.cumsum(size) - size
            of = np.repeat(np.arange(len(j)), size)
            i = np.arange(int(size.sum())) - start[of] + a[of]
            # The last bucket holds lengths i + 1 .. j.
            cost = best[i] + lengths[j[of]] * (rows[j[of] + 1] - rows[i + 1]) - (tokens[j[of] + 1] - tokens[i + 1])
            least = np.minimum.reduceat(cost, start)
            at = np.flatnonzero(cost == least[of])
            first = i[at[np.searchsorted(of[at], np.arange(len(j)))]]
            better = least < now[j]
            now[j[better]], cut[j[better]] = least[better], first[better]
            lo, hi, a, b = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (a, first), (first, b)))
            live = lo <= hi
            lo, hi, a, b = lo[live], hi[live], a[live], b[live]
        cuts.append(cut)
        best = now
    j = n - 1
    out = [int(lengths[j])]
    for cut in reversed(cuts):
        # Without a cut, one bucket less pads as little.
        if cut[j] >= 0:
            j = int(cut[j])
            out.append(int(lengths[j]))
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: str | None = None, buckets: int = 16, budget: int = 65536, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, bucket, bucket_len, batch, slot, padding) of each row of ``docs``, and the columns of ``carry``.

    ``tokens``: SQL for a row's length; by default, its words (runs without space or the controls 9 to 13). A null length counts
    as 0. All rows share at most ``buckets`` buckets, whose boundaries pad the whole table least. The histogram comes to the driver:
    it has an entry for each distinct length, so at most the longest text's length, and the root of twice the table's tokens.
    ``bucket_len`` tokens are given to each row of a bucket; a batch holds as many rows as ``budget`` has room for, one at least, and
    all batches of a bucket but its last are full.

    Rows stand in a bucket by the MD5 digest of id and length, then by these: equal rows are interchangeable, repeated rows stay
    repeated, and places don't depend on the number of partitions. A null id is an id. Without rows there are no batches. Other columns are not read.
    """
    spark = docs.sparkSession
    length = F.coalesce(F.expr(tokens or WORDS.format(text=f"`{text_col}`")).cast("long"), F.lit(0))
    # Lengths are counted once; what is carried along isn't read again until rows are placed.
    counted = written(docs.select(F.col(id_col).cast("long").alias("id"), length.alias("n_tokens"), *(F.col(c) for c in carry)))
    histogram = counted.groupBy("n_tokens").count().collect()
    lengths, counts = (np.array(x, np.int64) for x in (zip(*sorted(histogram)) if histogram else ([], [])))
    ends = boundaries(lengths, counts, buckets) or [0]
    bucket = F.lit(0)
    for end in ends[:-1]:
        bucket = bucket + (F.col("n_tokens") > end).cast("int")
    room = F.element_at(F.array(*map(F.lit, ends)), F.col("bucket") + 1)
    parts = 4 * partitions(spark)
    placed = counted.withColumn("bucket", bucket).withColumn("bucket_len", room.cast("long")).withColumn("__hash", F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "n_tokens")))
    # A bucket may hold most rows, so they are numbered in parts, ranges of the digest, and parts by the sizes of those before them.
    placed = placed.withColumn("__part", F.floor(F.conv(F.substring("__hash", 1, 8), 16, 10).cast("long") * parts / 2**32))
    sizes = placed.groupBy("bucket", "__part").agg(F.count("*").alias("__n"))
    before = sizes.select("bucket", "__part", (F.sum("__n").over(Window.partitionBy("bucket").orderBy("__part")) - F.col("__n")).alias("__before"))
    numbered = placed.withColumn("__row", F.row_number().over(Window.partitionBy("bucket", "__part").orderBy("__hash", "id", "n_tokens"))).join(before, ["bucket", "__part"])
    at = F.col("__before") + F.col("__row") - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1)))).cast("long")
    return numbered.select("id", "n_tokens", F.col("bucket").cast("long").alias("bucket"), "bucket_len", F.floor(at / capacity).cast("long").alias("batch"), F.pmod(at, capacity).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"), *carry)
