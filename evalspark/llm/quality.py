"""Operator 4, quality classifier: a weak-label model teaches a hashed linear scorer.

Ten overlapping heuristics vote good, bad or nothing on every document.
Expectation-maximisation over the counts of their vote patterns (all
documents; at most 3^10 rows reach the driver) estimates how often each
heuristic gives each vote on good and on bad documents, and from that the
posterior of every pattern. The posteriors are the labels of a logistic
scorer over hashed character-shape 4-grams. No human label is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.words import Words, chunk_bytes, chunks, split_words

#: Documents that the scorer is trained on at most, picked by a hash of their id.
TRAIN_ROWS = 6_000
DIMENSIONS = 4096
#: Bytes and rows of texts whose dense features are made together: 2 MB a table of features at most.
FEATURE_BYTES, FEATURE_ROWS = 200_000, 128
#: Bytes of texts voted on together; the arrays of their words take many times as much.
VOTE_BYTES = 500_000
STEPS, RATE, RIDGE = 150, 0.05, 1e-4
KEEP = 0.5

GOOD, BAD, NONE = 1, 0, 2

#: Very common words of the four languages.
COMMON = ("the of and to in a is it that for on as with was at by "
          "de la le les et en un une des est que du "
          "der die das und ist ein eine mit zu von den "
          "el los las y es por con se del").split()


# ---------------------------------------------------------------- heuristics

def _flags(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


_LETTER = _flags(lambda b: b >= 0x80 or chr(b).isalpha())
_UPPER = _flags(lambda b: 65 <= b <= 90)
_SYMBOL = _flags(lambda b: 0x21 <= b < 0x7F and not chr(b).isalnum() and chr(b) not in ".,;:'\"-?()")
_STOP = _flags(lambda b: chr(b) in ".?!" if b < 0x80 else False)


def _per_row(w: Words, flags: np.ndarray, row_end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[row_end], prepend=0)


def _common_hashes() -> np.ndarray:
    return np.sort(split_words(pa.array([" ".join(COMMON)])).hash)


def votes(texts: pa.Array) -> np.ndarray:
    """Vote of each heuristic (columns) on each row of one chunk."""
    w = split_words(texts, lower=False)
    low = split_words(texts, lower=True)
    row_end = chunk_bytes(texts)[1]
    lengths = np.diff(row_end, prepend=-1)
    n = np.maximum(w.counts, 1)
    row = w.row_of_word()

    def words_with(flag: np.ndarray) -> np.ndarray:
        return np.bincount(row[flag], minlength=w.rows)

    letters = np.maximum(_per_row(w, _LETTER[w.data], row_end), 1)
    size = np.maximum(w.end - w.start, 1)
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
    symbols = symbol[w.end] - symbol[w.start]
    again = np.zeros(len(row), dtype=bool)
    again[1:] = (low.hash[1:] == low.hash[:-1]) & (row[1:] == row[:-1])
    runs = np.zeros(len(row), dtype=bool)
    runs[2:] = again[2:] & again[1:-1]
    order = np.lexsort((low.hash, row))
    first = np.ones(len(row), dtype=bool)
    first[1:] = (low.hash[order][1:] != low.hash[order][:-1]) | (row[1:] != row[:-1])
    common = _common_hashes()
    at = np.minimum(np.searchsorted(common, low.hash), len(common) - 1)
    enough, many = w.counts >= 5, w.counts >= 40

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad & enough, BAD, np.where(good & enough, GOOD, NONE))

    symbol_share = _per_row(w, _SYMBOL[w.data], row_end) / lengths
    upper = _per_row(w, _UPPER[w.data], row_end) / letters
    repeats, in_runs = words_with(again) / n, words_with(runs) / n
    distinct = np.bincount(row[first], minlength=w.rows) / n
    stop_share = words_with(common[at] == low.hash) / n
    ends = words_with(_STOP[w.data[w.end - 1]]) / n
    all_symbols = words_with(symbols == size) / n
    mixed = words_with((symbols > 0) & (symbols < size)) / n
    word_size = np.bincount(row, weights=size, minlength=w.rows) / n
    return np.stack([
        vote(symbol_share > 0.05, symbol_share < 0.01),
        vote(upper > 0.4, upper < 0.12),
        vote(repeats > 0.2, repeats < 0.06),
        vote(in_runs > 0.1, in_runs < 0.01),
        vote((distinct < 0.12) & many, distinct > 0.25),
        vote((stop_share < 0.02) & many, stop_share > 0.08),
        vote((ends < 0.005) & many, (ends > 0.02) & (ends < 0.4)),
        vote(all_symbols > 0.1, all_symbols < 0.02),
        vote(mixed > 0.25, mixed < 0.05),
        vote(word_size > 14, word_size < 9),
    ], axis=1).astype(np.int8)


def pattern(v: np.ndarray) -> np.ndarray:
    """Votes of a row as one number, base 3."""
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1]))


def unpack(patterns: np.ndarray, n: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(n) % 3


@dataclass
class LabelModel:
    """Share of good documents, and of each vote (last axis) of each heuristic on bad and on good ones."""

    prior: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good, from the votes."""
        log = np.log(self.table[:, np.arange(v.shape[1])[None, :], v]).sum(axis=2)
        odds = np.log(self.prior / (1 - self.prior)) + log[1] - log[0]
        return 1 / (1 + np.exp(-np.clip(odds, -35, 35)))

    @classmethod
    def fit(cls, v: np.ndarray, counts: np.ndarray, rounds: int = 200) -> "LabelModel":
        """Expectation-maximisation from the majority vote; one row of votes for each pattern."""
        good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
        p = np.where(bad * 2 > good, 0.1, 0.9)
        for _ in range(rounds):
            weight = np.stack([(1 - p) * counts, p * counts])
            table = np.stack([[np.bincount(v[:, k], weights=wt, minlength=3)[:3] + 0.5 for k in range(v.shape[1])]
                              for wt in weight])
            model = cls(float(np.clip(weight[1].sum() / counts.sum(), 1e-3, 1 - 1e-3)),
                        table / table.sum(axis=2, keepdims=True))
            new = model.posterior(v)
            done, p = np.abs(new - p).max() < 1e-9, new
            if done:
                break
        return model


# ---------------------------------------------------------------- scorer

def _shape_classes() -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = (1 if b >= 0x80 else 2 if c.islower() else 3 if c.isupper() else 4 if c.isdigit() else
                  5 if c == " " else 6 if c.isspace() else 7 + "!#$%&*|.,".index(c) if c in "!#$%&*|.," else 0)
    return out


_SHAPE = _shape_classes()


def features(texts: pa.Array) -> np.ndarray:
    """Unit vectors of hashed 4-grams of character classes, and in column 0 the share of repeated words."""
    w = split_words(texts, lower=True)
    raw, row_end = chunk_bytes(texts)
    shape, lengths = _SHAPE[raw], np.diff(row_end, prepend=-1)
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    if len(raw) > 3:
        code = ((shape[:-3] * 16 + shape[1:-2]) * 16 + shape[2:-1]) * 16 + shape[3:]
        col = 1 + ((code * 0x9E3779B1) >> 7) % (DIMENSIONS - 1)
        row = np.repeat(np.arange(len(texts)), lengths)
        whole = row[:-3] == row[3:]  # a 4-gram lies in one text, with the separator behind it
        at = row[:-3][whole] * DIMENSIONS + col[whole]
        out += np.bincount(at, minlength=len(texts) * DIMENSIONS).reshape(-1, DIMENSIONS)
    out /= np.maximum(np.sqrt((out ** 2).sum(axis=1, keepdims=True)), 1)
    own = w.row_of_word()
    same = (w.hash[1:] == w.hash[:-1]) & (own[1:] == own[:-1])
    out[:, 0] = np.bincount(own[1:][same], minlength=len(texts)) / np.maximum(w.counts, 1)
    return out


def feature_slices(texts: pa.Array) -> Iterator[np.ndarray]:
    """Features of the rows in order, few rows at a time."""
    for lo, hi in chunks(texts, FEATURE_BYTES):
        for at in range(lo, hi, FEATURE_ROWS):
            yield features(texts[at:min(hi, at + FEATURE_ROWS)])


def fit_scorer(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights (the last one is the bias) of a logistic model for soft labels: Adam on the whole sample."""
    w, m, s = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -35, 35)))
        error = p - label
        g = np.append(x.T @ error.astype(np.float32) / len(x), error.mean()) + RIDGE * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    return w


@dataclass
class QualityModel:
    """Label model, posterior of every vote pattern of the corpus, and the scorer's weights (the last one is the bias)."""

    labels: LabelModel | None
    patterns: np.ndarray
    posterior: np.ndarray
    weights: np.ndarray

    def label(self, v: np.ndarray) -> np.ndarray:
        """Posterior of rows of votes."""
        return self.labels.posterior(v) if self.labels else np.full(len(v), 0.5)

    def score(self, texts: pa.Array) -> np.ndarray:
        found = [x @ self.weights[:-1] + self.weights[-1] for x in feature_slices(texts)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *found]), -35, 35)))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in chunks(batch.column(0), VOTE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(pattern(votes(batch.column(0)[lo:hi])))], names=["pattern"])


def _train(labels: LabelModel, train_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # filled in place: no second copy, and one block that goes back to the system
        x, n, y = np.empty((train_rows, DIMENSIONS), dtype=np.float32), 0, [np.zeros(0)]
        for batch in batches:
            for lo, hi in chunks(batch.column(0), VOTE_BYTES):
                for part in feature_slices(batch.column(0)[lo:hi]):
                    x[n:n + len(part)] = part
                    n += len(part)
                y.append(labels.posterior(votes(batch.column(0)[lo:hi])))
        w = fit_scorer(x[:n], np.concatenate(y))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(w)], names=["col", "weight"])
    return run


def fit_quality(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Label model from the votes on all rows, scorer from at most ``train_rows`` documents.

    The sample holds the first documents by a hash of their id, whatever
    the size of the corpus; one task reads it. Null texts vote nothing and
    are not in the sample; rows of equal ids are, each, within the bound. An
    empty table gives a model that scores 0.5.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = (docs.select("text").mapInArrow(_patterns, "pattern long")
               .groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect())
    if not counted:
        none = np.zeros(0)
        return QualityModel(None, none, none, np.zeros(DIMENSIONS + 1))
    found = np.array([r["pattern"] for r in counted], dtype=np.int64)
    v = unpack(found, votes(pa.array(["x"])).shape[1])
    labels = LabelModel.fit(v, np.array([r["n"] for r in counted], dtype=float))
    order = F.xxhash64(F.lit(4), F.col("doc_id"))
    docs = docs.where("doc_id is not null and text is not null")
    picked = docs.select("doc_id").orderBy(order).limit(train_rows)
    sample = (docs.join(F.broadcast(picked.distinct()), "doc_id")  # train_rows ids
              .orderBy(order, "text").limit(train_rows).select("text"))  # an id may have any number of rows
    rows = sample.mapInArrow(_train(labels, train_rows), "col long, weight double").collect()
    weights = np.zeros(DIMENSIONS + 1)
    for r in rows:
        weights[r["col"]] = r["weight"]
    return QualityModel(labels, found, labels.posterior(v), weights)


def _scored(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(1), VOTE_BYTES):
                texts = batch.column(1)[lo:hi]
                v = votes(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(model.score(texts).astype(float)), pa.array(model.label(v)),
                     pa.array((v == GOOD).sum(axis=1).astype(np.int32)), pa.array((v == BAD).sum(axis=1).astype(np.int32))],
                    names=["doc_id", "score", "posterior", "votes_good", "votes_bad"])
    return run


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1, higher: good likelier), posterior of the label
    model, votes_good, votes_bad, keep (1 if score >= 0.5).

    Null and empty texts have no features and get the score of the bias.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (slim.mapInArrow(_scored(model), "doc_id long, score double, posterior double, votes_good int, votes_bad int")
            .withColumn("keep", (F.col("score") >= KEEP).cast("int")))


def _kept(model: QualityModel, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(text), VOTE_BYTES):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(model.score(part.column(text)) >= KEEP))
    return run


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, unchanged, with all their columns."""
    return docs.mapInArrow(_kept(model, docs.columns.index("text")), docs.schema)
