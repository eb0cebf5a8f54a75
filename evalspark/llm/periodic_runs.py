"""Operator 11, periodic run detection: Kruskal over suffix classes, by descending LCP.

Suffixes of a document (of words) that share their first L words are a class.
Lowering L unites classes; the pairs of neighbours in suffix order, taken by
descending LCP, are the edges of that forest, and a union-find over ordered
sets of positions carries it out, the smaller set going into the larger one.
Two positions a < b that become neighbours in a set at level L have an LCP of
exactly L, so the words from a on have period b - a up to b + L and no further.
If that is long enough for the distance, and the word before a differs from the
one before b, it is a maximal run, and every run is found so: between its start
and its start plus period no position can lie in their class (a shorter period
would follow).

A run of at least ``min_length`` words and ``min_exponent`` periods needs a
repeated stretch of ``least_lcp`` words. Documents without one (most) are told
by the hashes of their word windows and never get a suffix order. Each document
is one unit of work with memory linear in its words times the logarithm of its longest
repeat; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.words import U64, chunks, mix, ngram_hashes, split_words, window_starts

MIN_LENGTH = 24
MIN_EXPONENT = 3
_BLOCK = 1024


def least_lcp(min_length: int, min_exponent: int) -> int:
    """Smallest LCP of the first two periods of any run that counts."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, and the LCP of each with the next, by prefix doubling."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank.astype(np.int32)], 1
    while step < n and rank.max() + 1 < n:
        behind = np.zeros(n, dtype=np.int64)
        behind[:n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        levels.append(rank.astype(np.int32))
        step *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        open_ = np.maximum(a, b) < n
        same = open_ & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        a[same] += 1 << k
        b[same] += 1 << k
    return order, a - order[:-1]


class PositionSet:
    """An ordered set of positions in sorted blocks; adding one tells its neighbours."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, x: int):
        self.blocks, self.lows, self.size = [[x]], [x], 1

    def add(self, x: int) -> tuple[int, int]:
        """Inserts x; its neighbours below and above, -1 for none."""
        k = max(bisect_right(self.lows, x) - 1, 0)
        block = self.blocks[k]
        i = bisect_right(block, x)
        below = block[i - 1] if i else -1  # below the first block there is nothing
        above = block[i] if i < len(block) else (self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1)
        block.insert(i, x)
        self.size += 1
        if not i:
            self.lows[k] = x
        if len(block) > _BLOCK:
            half = block[_BLOCK // 2:]
            del block[_BLOCK // 2:]
            self.blocks.insert(k + 1, half)
            self.lows.insert(k + 1, half[0])
        return below, above

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def document_runs(words: np.ndarray, min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    least = least_lcp(min_length, min_exponent)
    if len(words) <= least:
        return []
    order, lcp = suffix_order(words)
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    lefts, rights, levels = order[edges].tolist(), order[edges + 1].tolist(), lcp[edges].tolist()
    parent: dict[int, int] = {}
    sets: dict[int, PositionSet] = {}
    after: dict[int, int] = {}
    runs = []

    def root(x: int) -> int:
        if x not in parent:
            parent[x], sets[x], after[x] = x, PositionSet(x), -1
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    at = 0
    while at < len(levels):
        level, was = levels[at], {}
        while at < len(levels) and levels[at] == level:
            into, out = root(lefts[at]), root(rights[at])
            at += 1
            if sets[into].size < sets[out].size:
                into, out = out, into
            parent[out] = into
            target = sets[into]
            for x in sets.pop(out):
                below, above = target.add(x)
                was.setdefault(x, after[x])
                after[x] = above
                if below >= 0:
                    was.setdefault(below, after[below])
                    after[below] = x
        for a, old in was.items():  # neighbours since this level
            b = after[a]
            if b >= 0 and b != old:
                period = b - a
                if (level >= (min_exponent - 1) * period and level + period >= min_length
                        and (a == 0 or words[a - 1] != words[b - 1])):
                    runs.append((a, level + period, period))
    runs.sort(key=lambda r: (r[0], r[2]))
    return runs


def _rows_to_search(hashes: np.ndarray, at: np.ndarray, row: np.ndarray, least: int, rows: int) -> np.ndarray:
    """Whether each row holds a stretch of ``least`` words twice."""
    out = np.zeros(rows, dtype=bool)
    if len(at):
        with np.errstate(over="ignore"):
            key = mix(ngram_hashes(hashes, least, seed=23)[at] + mix(row.astype(U64) + U64(1)))
        order = np.argsort(key, kind="stable")
        twice = key[order[1:]] == key[order[:-1]]
        out[row[order[1:][twice]]] = True
    return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs(min_length: int, min_exponent: int):
    least = least_lcp(min_length, min_exponent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in chunks(texts):
                part = texts[lo:hi]
                w = split_words(part)
                search = _rows_to_search(w.hash, *window_starts(w, least), least, w.rows)
                runs, collapsed = [], []
                for r, text in enumerate(part.cast(pa.binary()).to_pylist()):
                    found = document_runs(w.hash[w.first[r]:w.first[r + 1]], min_length, min_exponent) if search[r] else []
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    if text is None:
                        collapsed.append(None)
                        continue
                    own = text.split()  # bytes: at space and 0x09-0x0D only
                    if found:
                        step = np.zeros(len(own) + 1, dtype=np.int64)
                        np.add.at(step, [s + p for s, _, p in found], 1)
                        np.add.at(step, [s + n for s, n, _ in found], -1)
                        own = compress(own, (np.cumsum(step[:-1]) == 0).tolist())
                    collapsed.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], pa.array(w.counts.astype(np.int64)), pa.array(runs, type=pa.list_(_RUN)),
                     pa.array(collapsed, type=pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed_text"])
    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_words, runs
    (array of start, length, period, by start, then period), collapsed_text.

    A run is a stretch of consecutive words with smallest period q and length
    at least max(min_length, min_exponent * q) that neither neighbouring word
    extends. ``min_exponent`` must be 2 or more. The collapsed text keeps the words that no run holds after its first
    period, joined by one space. Null text: no words, null collapsed text;
    empty text: "". Ids may be null or repeated, each row is judged alone.
    An empty table gives an empty result. Words are told apart by 64-bit
    hashes.
    """
    if min_exponent < 2:
        raise ValueError("min_exponent must be 2 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_runs(min_length, min_exponent),
                           "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
                           "collapsed_text string")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with a repeated tail in the texts of one id in ten; the other texts are unchanged.

    With h the crc32 of the decimal id, g = h div 10, h % 10 = 0 and n > 0
    words, word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8). Such a text's words are joined by one
    space. Rows with a null id, null text or no words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        source = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(source, lambda i: F.get(w, i.cast("int"))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # the array of one element gives the words a name, so they are made once
    made = F.get(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), repeated), 0)
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), F.coalesce(made, "text"))
                           .otherwise(F.col("text")))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (ties: smallest start, then period; no run: nulls) as
    start, length, period, exponent_milli; SHA-256 of the list of runs and of the collapsed text."""
    best = F.aggregate("runs", F.get("runs", 0), lambda m, r: F.when(
        r["length"] * m["period"] > m["length"] * r["period"], r).otherwise(m))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                   F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed_text", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"))
