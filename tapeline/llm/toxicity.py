"""Toxicity of texts by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

The trading project has no labelled texts of its own, so the operator is general: a text has ``text_id`` and ``text``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.text import LOWER, SPACE, Prints, mix, slices, words

BITS = 20
#: Labelled texts that the fit takes at most, those with the smallest hash of seed and id.
MOST_LABELLED = 10_000
_APART = SPACE.copy()
_APART[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and the row of each: words, pairs, triples, and pairs with one or two words between."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets, _APART)
    h = Prints(data)(starts, ends)
    found, rows = [h], [row]
    for kind, steps in enumerate([(1,), (1, 2), (2,), (3,)], 1):
        reach = steps[-1]
        if len(h) <= reach:
            continue
        x = h[:-reach] * np.uint64(2 * kind + 1)
        for j, s in enumerate(steps):
            x = mix(x) + h[s : len(h) - reach + s] * np.uint64(7 + j)
        same = row[:-reach] == row[reach:]
        found.append(mix(x)[same])
        rows.append(row[:-reach][same])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """Weights with a learning rate of their own and an L1 threshold, updated one text at a time."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


def fit(labelled: Iterator[tuple[np.ndarray, int]], epochs: int = 12, **rates: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that are not zero; the last place is the bias.

    Features whose weight is zero after the first pass stay out of the later ones.
    """
    rows = [(np.append(np.unique(x), 1 << BITS), y) for x, y in labelled]
    model = Ftrl(**rates)
    order = np.random.default_rng(7)
    for epoch in range(epochs):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i])
        if epoch == 0:
            live = model.weights(slice(None)) != 0
            live[-1] = True
            model.z[~live] = 0
            rows = [(x[live[x]], y) for x, y in rows]
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return at, w[at]


def train(texts: DataFrame, labels: DataFrame, text_id: str = "text_id", text: str = "text", toxic: str = "toxic", most: int = MOST_LABELLED, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights from at most ``most`` labelled texts: ``labels`` has ``text_id`` and ``toxic``.

    The sample are the ids with the smallest hash, chosen before any text is
    read, so only a bounded table is sent to the texts.  Hashing is spread; the
    fit is one pass in order over hashed features of the sample, in one task.
    Rows without a label or an id take no part; of several labels or texts of
    one id the smallest counts; without labels all weights are zero.
    """
    known = labels.filter(F.col(toxic).isNotNull() & F.col(text_id).isNotNull()).groupBy(F.col(text_id).cast("bigint").alias("text_id")).agg(F.min(F.col(toxic).cast("int")).alias("toxic"))
    chosen = known.withColumn("order", F.xxhash64(F.lit(seed), "text_id")).orderBy("order", "text_id").limit(most)
    rows = texts.select(F.col(text_id).cast("bigint").alias("text_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sample = rows.join(F.broadcast(chosen), "text_id").groupBy("order", "toxic").agg(F.min("text").alias("text")).select("order", "text", "toxic")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            x, row = features(data, offsets)
            sets = [np.unique(x[row == i]) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.astype(np.int32) for s in sets], pa.list_(pa.int32())), part.column(2)], names=["order", "features", "toxic"])

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by("order")
        lists = table.column("features").combine_chunks()
        pairs = ((np.asarray(lists[i].values), y) for i, y in enumerate(table.column("toxic").to_pylist()))
        at, value = fit(pairs)
        return pa.table({"place": pa.array(at, pa.int64()), "value": pa.array(value, pa.float64())})

    vectors = sample.mapInArrow(hashed, "order bigint, features array<int>, toxic int")
    # One group of at most ``most`` rows.
    weights = vectors.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fitted, "place bigint, value double").toArrow()
    return weights.column("place").to_numpy(), weights.column("value").to_numpy()


def score(texts: DataFrame, weights: tuple[np.ndarray, np.ndarray], text_id: str = "text_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``text_id, score, predicted`` of every whole text; null and empty texts have the score of the bias alone.

    The weights that are not zero, at most ``2**BITS``, are sent to the tasks.
    """
    table = np.zeros((1 << BITS) + 1, np.float32)
    table[weights[0]] = weights[1]
    shared = texts.sparkSession.sparkContext.broadcast((weights[0], table[weights[0]]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value = shared.value
        w = np.zeros((1 << BITS) + 1, np.float32)
        w[at] = value
        for part, data, offsets in slices(batches, "text"):
            x, row = features(data, offsets)
            hit = np.flatnonzero(w[x])
            each = np.unique((row[hit] << (BITS + 1)) | x[hit])
            total = np.bincount(each >> (BITS + 1), weights=w[each & ((1 << (BITS + 1)) - 1)], minlength=part.num_rows) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["text_id", "score", "predicted"])

    rows = texts.select(F.col(text_id).cast("bigint").alias("text_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scored, "text_id bigint, score double, predicted int")
