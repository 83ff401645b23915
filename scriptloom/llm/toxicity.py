"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashed words, pairs of neighbours and pairs with one word between, each once. Every
coordinate has its own learning rate, and the L1 term keeps all but a few thousand weights at zero, which makes the
model small enough to ship with each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import ready_python
from scriptloom.llm.labelled import crc_mod, labelled_sample
from scriptloom.llm.textnum import blocks, mix, split_words

BITS = 20
SAMPLE = 12_000


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, pair of neighbours and skip pair; a feature can occur again."""
    w = split_words(data, offsets, stops=True)
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    out_text, out = [text], [mix(w.hashes)]
    for gap, factor in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        if len(text) > gap:
            same = text[gap:] == text[:-gap]
            out_text.append(text[:-gap][same])
            out.append(mix(w.hashes[:-gap][same] * np.uint64(factor) + w.hashes[gap:][same]))
    return np.concatenate(out_text), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Binary features, log loss. The intercept starts at the smoothed log odds of the labels and is not penalised."""

    def __init__(self, positives: int, rows: int, alpha: float = 1.0, beta: float = 1.0, l1: float | None = None, l2: float = 1.0, positive: float = 3.0):
        """``l1``: as a rule a 600th of the rows, 1 at least, as the gradients of chance features add up over the rows."""
        self.alpha, self.beta, self.l1, self.l2, self.positive = alpha, beta, max(1.0, rows / 600) if l1 is None else l1, l2, positive
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        share = (positives + 0.5) / (rows + 10)
        self.intercept, self.seen = float(np.log(share / (1 - share))), 0.0

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + self.intercept, -35, 35)))
        g = (p - label) * (self.positive if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.seen += g * g
        self.intercept -= 0.05 * g / (1 + np.sqrt(self.seen))


def train(sample: DataFrame, epochs: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """(features with a weight, their weights, intercept). Features are made where the texts are; one task then learns
    from the sample, whose size is bounded, in the order of hashed ids."""

    def featured(batches):
        for batch in batches:
            ids, labels = batch.column(0), batch.column(2)
            for row, data, offsets in blocks(batch.column(1)):
                n = len(offsets) - 1
                text, feature = grams(data, offsets)
                keys = np.unique(text << BITS | feature)
                edges = np.searchsorted(keys, np.arange(n + 1) << BITS)
                own = (keys & ((1 << BITS) - 1)).astype("<i4")
                yield pa.RecordBatch.from_arrays([ids.slice(row, n), labels.slice(row, n), pa.array([own[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], names=["doc_id", "label", "features"])

    def fit(batches):
        rows = [(label, np.frombuffer(f, "<i4")) for batch in batches for label, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        model = Ftrl(sum(label for label, _ in rows), len(rows))
        for _ in range(epochs):
            for label, at in rows:
                model.learn(at, label)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([model.intercept, *w[at].tolist()], pa.float64())], names=["feature", "weight"])

    gathered = sample.select("doc_id", "text", "label").mapInArrow(featured, "doc_id long, label int, features binary")
    one = gathered.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    model = one.select("label", "features").mapInArrow(fit, "feature long, weight double").toPandas().sort_values("feature")
    if not len(model):
        return np.zeros(0, np.int64), np.zeros(0), -3.0
    return model["feature"].to_numpy()[1:], model["weight"].to_numpy()[1:], float(model["weight"].iloc[0])


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from at most ``sample_rows`` labelled documents that are not held out. Null or empty text has the score of
    the intercept alone; a null doc_id is not held out; repeated rows are scored alike; with no labels every score is
    the intercept's default, below 0.5. An empty table gives no rows; other columns are ignored.
    """
    ready_python(docs.sparkSession)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    features, weights, intercept = train(labelled_sample(docs, labels, "toxic", held_out, sample_rows))

    def scored(batches):
        table = np.zeros(1 << BITS)
        table[features] = weights
        for batch in batches:
            for row, data, offsets in blocks(batch.column(2)):
                n = len(offsets) - 1
                text, feature = grams(data, offsets)
                hit = table[feature] != 0
                keys = np.unique(text[hit] << BITS | feature[hit])
                sums = np.bincount(keys >> BITS, table[keys & ((1 << BITS) - 1)], n) + intercept
                score = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
