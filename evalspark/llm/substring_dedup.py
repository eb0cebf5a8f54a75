"""Operator 3, substring dedup: minimizer blocks and window hashes, in place of a greedy relative Lempel-Ziv parse.

Every document is a reference for the documents with larger ids. It is cut
at content-defined places into blocks: consecutive windows (``window`` words
each) with the same minimizer, that is the same smallest hash among the
``GRAM``-word grams of the window. All blocks of all documents are indexed
by that hash. A window found in two documents has the same minimizer in
both, so everything a document can copy is in blocks under its own keys.

No document is factored. Where all blocks under a key are equal, every
window of the block is a copy in all documents but the first that holds it.
Where they differ, which is at the ends of a copied passage, the windows of
the block are joined by their hashes. Words under copied windows are removed;
runs of them are the duplicate spans.

Only keys, block hashes and the windows of blocks that differ are shuffled beside
the one exchange of the texts by document. Hot keys are aggregated before
the shuffle or met in joins that the adaptive skew join splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.key_filter import KeyFilter
from evalspark.llm.staging import staged
from evalspark.llm.words import U64, Words, _powers, chunks, mix, ngram_hashes, split_words, window_starts

WINDOW = 13
GRAM = 5
_P = 0xD6E8FEB86659FD93


def _sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    size, out = 1, g
    while size < n:
        step = min(size, n - size)
        out = np.minimum(out[:-step], out[step:])
        size += step
    return out


def _window_keys(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, row and minimizer of every window."""
    gram = min(GRAM, window)
    at, row = window_starts(w, window)
    if not len(at):
        return at, row, np.zeros(0, dtype=U64)
    return at, row, _sliding_min(ngram_hashes(w.hash, gram, seed=3), window - gram + 1)[at]


def _block_starts(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(row):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))


def _span_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words lo..hi-1 of each span."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, dtype=U64)
        np.cumsum(h * _powers(_P, len(h)), out=sums[1:])
        inverse = _powers(pow(_P, -1, 1 << 64), len(h) + 1)
        return mix((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(U64) * U64(0x9E3779B97F4A7C15))


def _blocks(window: int, repeated: KeyFilter | None = None):
    """key, block and doc_id of every block; with a filter, key and doc_id of those whose key it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in chunks(texts):
                w = split_words(texts[lo:hi])
                at, row, key = _window_keys(w, window)
                first = _block_starts(row, key)
                if not len(first):
                    continue
                if repeated is not None:
                    first = first[repeated.may_hold(key[first])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[first].view(np.int64)), ids[lo:hi].take(pa.array(row[first]))], names=["key", "doc_id"])
                    continue
                last = np.append(first[1:], len(at)) - 1
                block = _span_hashes(w.hash, at[first], at[last] + window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first].view(np.int64)), pa.array(block.view(np.int64)),
                     ids[lo:hi].take(pa.array(row[first]))], names=["key", "block", "doc_id"])
    return run


def _end_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, texts, keys = (batch.column(k) for k in range(4))
            for lo, hi in chunks(texts):
                w = split_words(texts[lo:hi])
                at, row, key = _window_keys(w, window)
                keep = _in_rows(row, key, keys[lo:hi])
                if not keep.any():
                    continue
                at, row = at[keep], row[keep]
                pair = [ngram_hashes(w.hash, window, seed=s)[at].view(np.int64) for s in (5, 7)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[0]), pa.array(pair[1]), ids[lo:hi].take(pa.array(row)),
                     rows[lo:hi].take(pa.array(row)), pa.array((at - w.first[row]).astype(np.int32))],
                    names=["h1", "h2", "doc_id", "row", "pos"])
    return run


def _in_rows(row: np.ndarray, value: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its row (null: in none)."""
    out = np.zeros(len(row), dtype=bool)
    bound = np.searchsorted(row, np.arange(len(lists) + 1))
    for r in range(len(lists)):
        if lists[r].is_valid and bound[r] < bound[r + 1]:
            own = lists[r].values.to_numpy(zero_copy_only=False).view(U64)
            out[bound[r]:bound[r + 1]] = np.isin(value[bound[r]:bound[r + 1]], own)
    return out


def _factored(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, whole, ends = (batch.column(k) for k in range(4))
            for lo, hi in chunks(texts):
                w = split_words(texts[lo:hi])
                at, row, key = _window_keys(w, window)
                copied = at[_in_rows(row, key, whole[lo:hi])]
                for r in range(hi - lo):
                    if ends[lo + r].is_valid:
                        pos = ends[lo + r].values.to_numpy(zero_copy_only=False)
                        copied = np.concatenate([copied, w.first[r] + pos.astype(np.int64)])
                step = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(step, copied, 1)
                np.add.at(step, copied + window, -1)
                yield _spans(ids[lo:hi], w, np.cumsum(step[:-1]) > 0, texts[lo:hi])
    return run


def _spans(ids: pa.Array, w: Words, covered: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """Kept text and duplicate spans of each row."""
    kept, starts, lengths, removed = [], [], [], []
    for r in range(w.rows):
        a, b = w.first[r], w.first[r + 1]
        c = covered[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(np.int8)))
        starts.append(edge[::2].astype(np.int32))
        lengths.append((edge[1::2] - edge[::2]).astype(np.int32))
        removed.append(int(c.sum()))
        if not texts[r].is_valid:
            kept.append(None)
            continue
        stay = np.flatnonzero(~c) + a
        if not len(stay):
            kept.append("")
            continue
        base, stop = w.start[a], w.end[b - 1]
        mark = np.zeros(stop - base + 2, dtype=np.int8)
        mark[w.start[stay] - base] += 1
        mark[w.end[stay] - base + 1] -= 1  # with the separator after the word
        text = w.data[base:stop + 1].copy()
        text[w.end[a:b] - base] = 0x20
        kept.append(text[np.cumsum(mark[:-1]) > 0].tobytes()[:-1].decode())
    lists = [pa.array(x, type=pa.list_(pa.int32())) for x in (starts, lengths)]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(w.counts.astype(np.int64)), pa.array(removed, type=pa.int64()), *lists,
         pa.array(kept, type=pa.string())],
        names=["doc_id", "n_words", "n_removed", "span_start", "span_length", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_words,
    n_removed, span_start and span_length (the duplicate spans, in words), kept_text.

    A word is removed if a window over it also starts in a document with a
    smaller id; windows are judged on the input. Kept words are joined by
    one space. Null text: no words, null kept_text; empty text: "". Texts
    shorter than a window are kept whole. Rows with equal ids don't remove
    from each other; a row with null id neither removes nor loses words. An
    empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with_id = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    blocks = with_id.mapInArrow(_blocks(window), "key long, block long, doc_id long")
    # written first, so that the join meets plain exchanges, whose hot keys can be split
    index = staged(blocks.groupBy("key")
                   .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
                        (F.min("block") != F.max("block")).alias("mixed"))
                   .where("first_doc < last_doc").drop("last_doc"), "rlz-index")
    # most blocks are of one document: they are dropped in the tasks that make them
    shared = with_id.mapInArrow(_blocks(window, KeyFilter(index)), "key long, doc_id long")
    found = staged(shared.join(index, "key").where("mixed or doc_id > first_doc")
                   .groupBy("doc_id")
                   .agg(F.collect_set(F.when(~F.col("mixed"), F.col("key"))).alias("whole"),
                        F.collect_set(F.when(F.col("mixed"), F.col("key"))).alias("ends")), "rlz-blocks")
    # positions belong to a text: rows with equal ids can hold different ones
    row = F.hash("text").alias("row")
    at_ends = staged(with_id.join(found.select("doc_id", "ends").where(F.size("ends") > 0), "doc_id")
                     .select("doc_id", row, "text", "ends")
                     .mapInArrow(_end_windows(window), "h1 long, h2 long, doc_id long, row int, pos int"), "rlz-ends")
    # written: beside an aggregate of the same keys the join could not split a hot window
    first = staged(at_ends.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
                   .where("first_doc < last_doc").drop("last_doc"), "rlz-first")
    copied = (KeyFilter(first, "h1").keep(at_ends, "h1").join(first, ["h1", "h2"]).where("doc_id > first_doc")
              .groupBy("doc_id", "row").agg(F.collect_set("pos").alias("positions")))
    return (docs.withColumn("row", row).join(found.select("doc_id", "whole"), "doc_id", "left")
            .join(copied, ["doc_id", "row"], "left")
            .select("doc_id", "text", "whole", "positions")
            .mapInArrow(_factored(window), "doc_id long, n_words long, n_removed long, span_start array<int>, "
                                           "span_length array<int>, kept_text string"))
