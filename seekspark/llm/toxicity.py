"""Operator 8, toxicity scores from a factorization machine over hashed terms.

A text is the set of its hashed terms. Beside a weight, each term has a short vector,
and the product of two terms' vectors adds to the score of texts that hold both, so an
insult counts otherwise next to a mention of people than alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm._arrow import mix, slices, utf8, word_hashes, words
from seekspark.llm._shared import extended
from seekspark.llm.decontam import LOWER, PARTING

#: Hashed terms: 2**BITS of them.
BITS = 18
#: Labelled rows that a model is fitted on, at most: those whose hashed id is least.
SAMPLE = 20_000
RANK = 6
#: Samples of up to so many rows are joined by broadcast.
BROADCAST_ROWS = 500_000
#: Bytes of a longer word that are a term too.
STEMS = (4, 6)
#: Terms whose share differs less between the classes, in standard errors, are *even*: they are drawn to zero more strongly, by these decays of weight and vector, which only what many texts say outweighs.
LEAST_Z = 3.0
EVEN_DECAY = 0.02
EVEN_VECTOR_DECAY = 0.04
#: An even term in a smaller share of the texts stays at zero, where its decay would keep it: a pair of terms moves their vectors by its share of the texts, at most.
EVEN_SHARE = 0.05
SLICE = 2 << 20


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability for each text, given the terms of all end to end and where each text's begin."""
        return 1 / (1 + np.exp(-np.clip(_raw(self.bias, self.weights, self.vectors, terms, bounds)[0], -30, 30)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _raw(bias, weights, vectors, terms, bounds):
    v = vectors[terms]
    inner = _sums(v, bounds)
    return bias + _sums(weights[terms], bounds) + 0.5 * (inner**2 - _sums(v * v, bounds)).sum(1), inner, v


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of each text, ascending, end to end, and their bounds. Terms are words (runs of digits, letters and non-ASCII characters, A-Z lowered) and, of longer words, the first bytes: inflections of one stem share them."""
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets, PARTING)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.uint64) << np.uint64(BITS)
    found = [doc | (mix(word_hashes(data, starts, ends)) >> np.uint64(64 - BITS))]
    for n in STEMS:
        longer = np.flatnonzero(ends - starts > n)
        found.append(doc[longer] | (mix(word_hashes(data, starts[longer], starts[longer] + n) + np.uint64(n)) >> np.uint64(64 - BITS)))
    both = np.unique(np.concatenate(found))
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(both >> np.uint64(BITS), np.arange(len(bounds)))


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 2e-5, batch: int = 256, seed: int = 7) -> Model:
    """A factorization machine fitted by AdaGrad on the logistic loss, classes weighted alike up to a ratio of 4. Terms of fewer than three texts keep zero weights and vectors. Terms as frequent in either class (``LEAST_Z``) are fitted with stronger decays, so that pairs count whose terms tell nothing alone; those in fewer than ``EVEN_SHARE`` of the texts stay at zero. Without labels of both kinds it is constant."""
    model = Model(0.0, np.zeros(1 << BITS), np.zeros((1 << BITS, RANK)))
    share = labels.mean() if len(labels) else 0.0
    model.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not 0 < share < 1:
        return model
    rng = np.random.default_rng(seed)
    ones = [x for x, y in zip(texts, labels) if y == 1]
    n_all, n_one = len(texts), len(ones)
    held, held_one = (np.bincount(np.concatenate(x), minlength=1 << BITS) for x in (texts, ones))
    p = held / n_all
    error = np.sqrt(p * (1 - p) * (1 / n_one + 1 / (n_all - n_one))) + 1e-12
    uneven = (held >= 3) & (np.abs(held_one / n_one - (held - held_one) / (n_all - n_one)) >= LEAST_Z * error)
    known = np.flatnonzero(uneven | (held >= max(3, EVEN_SHARE * n_all)))
    uneven = uneven[known]
    decay_w, decay_v = np.where(uneven, decay, EVEN_DECAY), np.where(uneven, 5 * decay, EVEN_VECTOR_DECAY)
    if not len(known):
        return model
    compact = np.full(1 << BITS, -1)
    compact[known] = np.arange(len(known))
    own = [y[y >= 0] for y in (compact[x] for x in texts)]
    w, v, b = np.zeros(len(known)), rng.normal(0, 0.01, (len(known), RANK)), model.bias
    gw, gv, gb = np.full(len(w), 1e-3), np.full(v.shape, 1e-3), 1e-3
    importance = np.where(labels == 1, min(4.0, (1 - share) / share), 1.0)
    mean_w, mean_v, mean_b, n = np.zeros_like(w), np.zeros_like(v), 0.0, 0
    for epoch in range(epochs):
        order = rng.permutation(len(own))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            sizes = np.array([len(own[r]) for r in rows])
            terms, bounds = np.concatenate([own[r] for r in rows]), np.concatenate([[0], np.cumsum(sizes)])
            raw, inner, rows_v = _raw(b, w, v, terms, bounds)
            error = importance[rows] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
            each = np.repeat(error, sizes)
            grad_w = np.bincount(terms, each, len(w)) + decay_w * w
            gw += grad_w**2
            w -= rate * grad_w / np.sqrt(gw)
            pull = each[:, None] * (np.repeat(inner, sizes, axis=0) - rows_v)
            for f in range(RANK):
                grad_v = np.bincount(terms, pull[:, f], len(w)) + decay_v * v[:, f]
                gv[:, f] += grad_v**2
                v[:, f] -= rate / 4 * grad_v / np.sqrt(gv[:, f])
            gb += error.sum() ** 2
            b -= rate * error.sum() / np.sqrt(gb)
        if epoch >= epochs // 2:
            mean_w, mean_v, mean_b, n = mean_w + w, mean_v + v, mean_b + b, n + 1
    model.weights[known], model.vectors[known], model.bias = mean_w / n, mean_v / n, float(mean_b / n)
    return model


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model fitted on labelled rows that aren't held out: the ``sample`` of them, at most, whose hashed ids are least.

    Rows without an id, a label or a text are left out; of several labels for an id the largest counts. Only ids, labels and
    the hashed terms of the sampled texts come to the driver, all of them: four bytes a term, 2**BITS terms of a text at most.
    """
    key = F.col(id_col).cast("long")
    chosen = labels.filter(key.isNotNull() & F.col(label_col).isNotNull() & ~held_out(key)).groupBy(key.alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # At most ``sample`` rows of 16 bytes: small samples spare the texts a shuffle.
    chosen = F.broadcast(chosen) if sample <= BROADCAST_ROWS else chosen
    rows = docs.filter(F.col(text_col).isNotNull()).select(key.alias("__id"), F.col(text_col).cast("string").alias("__text")).join(chosen, "__id").select("__id", "__label", "__text")

    def each(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            terms, bounds = terms_of(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([terms[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())], names=["id", "label", "terms"])

    got = sorted((r.id, bytes(r.terms), r.label) for r in rows.mapInArrow(each, "id long, label int, terms binary").toLocalIterator())
    return fit([np.frombuffer(t, np.int32).astype(np.int64) for _, t, _ in got], np.array([x for *_, x in got], np.float64))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is toxic. Nothing but the text is read; null and empty texts get the model's prior. A column named ``score_col`` is replaced. Repeated rows stay; an empty table gives no rows."""
    docs = docs.drop(score_col)
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights.astype(np.float32), model.vectors.astype(np.float32)))

    def each(batches):
        own = Model(*sent.value)
        for batch in batches:
            data, offsets = utf8(batch.column(names.index(text_col)))
            found = [own.scores(*terms_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in slices(offsets, SLICE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], names=[*names, score_col])

    return docs.mapInArrow(each, extended(docs, f"`{score_col}` double"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with its own columns, that score below ``cutoff``; the model is trained on ``docs`` and ``labels``. Nulls and empty tables as in :func:`score`."""
    return score(docs, train(docs, labels, id_col, text_col), text_col, "__score").filter(F.col("__score") < cutoff).select(*docs.columns)
