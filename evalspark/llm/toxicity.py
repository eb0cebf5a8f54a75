"""Operator 9, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased. Features are words, word
pairs and pairs with one word between them, hashed to ``DIMENSIONS``
columns. Every coordinate has a learning rate of its own; the L1 term keeps
most weights at exactly 0, so what is sent to the scoring tasks is a short
list of columns and weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.words import NOT_ALNUM, U64, Words, chunks, mix, split_words

DIMENSIONS = 1 << 20
#: Labelled rows that are used for training at most, picked by a hash of their id.
TRAIN_ROWS = 20_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 1.0


def columns_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every feature occurrence of one chunk, ordered by kind, then place."""
    h, row = w.hash, w.row_of_word()
    rows, cols = [row], [h]
    with np.errstate(over="ignore"):
        for gap, seed in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                rows.append(row[gap:][same])
                cols.append(mix(h[:-gap] * U64(seed) + h[gap:])[same])
    return np.concatenate(rows), (np.concatenate(cols) % U64(DIMENSIONS)).astype(np.int64)


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct columns of each row, and their values: damped counts."""
    w = split_words(texts, lower=True, separators=NOT_ALNUM)
    row, col = columns_of(w)
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    at = np.searchsorted(row, np.arange(w.rows + 1))
    for r in range(w.rows):
        c, n = np.unique(col[at[r]:at[r + 1]], return_counts=True)
        yield c, 1 + np.log(n)


@dataclass
class Ftrl:
    """State of FTRL-proximal; column DIMENSIONS is the bias, which has no L1 term."""

    alpha: float = ALPHA
    beta: float = BETA
    l1: float = L1
    l2: float = L2

    def __post_init__(self):
        self.z = np.zeros(DIMENSIONS + 1)
        self.n = np.zeros(DIMENSIONS + 1)

    def weights(self, cols: np.ndarray) -> np.ndarray:
        z = self.z[cols]
        l1 = np.where(cols == DIMENSIONS, 0.0, self.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[cols])) / self.alpha + self.l2)

    def learn(self, cols: np.ndarray, values: np.ndarray, label: int) -> None:
        cols, values = np.append(cols, DIMENSIONS), np.append(values, 1.0)
        w = self.weights(cols)
        g = (_sigmoid(w @ values) - label) * values
        n = self.n[cols]
        self.z[cols] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[cols] = n + g * g


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Weights:
    """The weights that are not 0, and the bias."""

    cols: np.ndarray
    values: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(DIMENSIONS, dtype=np.float32)
        out[self.cols] = self.values
        return out


def _train(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            texts, labels = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                held += [(c.astype(np.int32), v.astype(np.float32), y)
                         for (c, v), y in zip(_features(texts[lo:hi]), labels[lo:hi])]
        model = Ftrl()
        for _ in range(epochs):
            for c, v, y in held:
                model.learn(c, v.astype(float), y)
        w = model.weights(np.arange(DIMENSIONS + 1))
        cols = np.append(np.flatnonzero(w[:-1]), DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array(cols), pa.array(w[cols])], names=["col", "weight"])
    return run


def held_out(doc_id) -> F.Column:
    """Whether a document's label must not be learned from: crc32 of its id as text, mod 5, is 0 (null ids: true)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> Weights:
    """Weights learned from at most ``max_rows`` labelled documents that are not held out.

    The rows are the first by a hash of their id, so the sample is bounded
    at every size of the corpus; one task reads it in that order. Null
    labels and ids are left out. Of rows with equal ids each counts.
    Without any labelled row all weights are 0 and every score is 0.5.
    """
    order = F.xxhash64(F.lit(9), F.col("doc_id"))
    picked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
              .orderBy(order, "label").limit(max_rows))
    sample = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .join(F.broadcast(picked), "doc_id")  # max_rows rows of two numbers
              .repartition(1).sortWithinPartitions(order, "label", "text").select("text", "label"))
    found = {r["col"]: r["weight"] for r in sample.mapInArrow(_train(epochs), "col long, weight double").collect()}
    bias = found.pop(DIMENSIONS, 0.0)
    return Weights(np.array(sorted(found), dtype=np.int64), np.array([found[c] for c in sorted(found)]), bias)


def _score(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = weights.dense()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in chunks(texts):
                w = split_words(texts[lo:hi], lower=True, separators=NOT_ALNUM)
                row, col = columns_of(w)
                value = dense[col]
                used = np.flatnonzero(value)
                # a column's occurrences in a row count with a damped weight, as in training
                key, n = np.unique(row[used] * DIMENSIONS + col[used], return_counts=True)
                total = np.bincount(key // DIMENSIONS, weights=dense[key % DIMENSIONS] * (1 + np.log(n)),
                                    minlength=w.rows)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(_sigmoid(total + weights.bias))],
                                                 names=["doc_id", "score"])
    return run


def score_toxicity(docs: DataFrame, weights: Weights) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Only the text is an input of the score. Empty and null texts get the
    score of the bias. An empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (slim.mapInArrow(_score(weights), "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> DataFrame:
    """Fits on ``labels`` and scores every document."""
    return score_toxicity(docs, fit_toxicity(docs, labels, max_rows, epochs))
