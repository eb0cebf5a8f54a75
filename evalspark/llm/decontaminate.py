"""Operator 2, benchmark decontamination: CGK random walks and bit sampling.

The CGK embedding reads a window of words in a random walk: at every step it
writes the current word, and a random bit of that word and step tells whether
it goes on to the next one. Windows at a small edit distance get embeddings
at a small Hamming distance, as walks that part meet again. Each repeat
samples a few positions of an embedding of its own as the key of a window.

A document is read from every word on, and so is an item. A walk that stays
in a stretch without edits has the same key on both sides, so the worst
placing of the edits that an item of n words may have gives the least chance
of a repeat to find it, and from that the repeats that n words need for
``RECALL``. Items that would need more than ``REPEATS`` (short ones), or may
have no edits, are cut into one piece more than they may have edits: one piece
is whole in every match and is looked up by its hash. Text under an equal key is aligned with
the item, and the word edit distance of the whole item against the text
around it decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.words import NOT_ALNUM, U64, Words, chunks, mix, ngram_hashes, split_words, window_starts

SIMILARITY = 0.8
#: Items with fewer words are not looked for: every item that has words is.
MIN_WORDS = 1
#: Least share of the items found, wherever their edits are, and most repeats spent on it.
RECALL = 0.99
REPEATS = 12
#: Steps of a walk (it reads half as many words on average), sampled positions, and words that they fall on at least.
STEPS, SAMPLED, LEAST = 8, 6, 3
#: Items of more words hold a stretch of so many words with no more than its share of the edits.
LONGEST = 60
#: Words of a piece that are looked up at most.
LONG_PIECE = 8
#: Walks that are made together, so that they stay in the processor's cache.
TOGETHER = 1 << 15
#: Bytes of items that one pass sends to every task; more items take more passes.
PASS_BYTES = 16_000_000


def _samples(r: int) -> np.ndarray:
    """Sampled positions of a repeat: one of each of SAMPLED stretches of the walk, so that they fall on different words."""
    edge = np.linspace(0, STEPS, SAMPLED + 1).astype(int)
    return np.random.default_rng([STEPS, SAMPLED, r]).integers(edge[:-1], edge[1:])


@lru_cache(maxsize=None)
def _chances(r: int) -> np.ndarray:
    """Chance of a repeat's walk from the first of k words to stay in them and sample LEAST of them, for k up to LONGEST."""
    sampled, out = _samples(r), np.zeros(LONGEST + 1)
    for moves in product((0, 1), repeat=int(sampled[-1])):
        at = np.concatenate([[0], np.cumsum(moves)])
        if len(set(at[sampled].tolist())) >= LEAST:
            out[int(at[-1]) + 1:] += 0.5 ** len(moves)
    return out


def repeats_for(n: int, edits: int) -> int | None:
    """Repeats that find an item of ``n`` words with ``edits`` edits anywhere with RECALL; None for more than REPEATS."""
    return _repeats(n, edits) if n <= LONGEST else _repeats(LONGEST, LONGEST * edits // n)


@lru_cache(maxsize=None)
def _repeats(n: int, edits: int) -> int | None:
    missed = np.zeros(LONGEST + 1)
    for r in range(REPEATS):
        with np.errstate(divide="ignore"):
            missed = missed + np.log(1 - _chances(r))
        # the edits leave edits + 1 stretches of n - edits words together: the most that all of them can be missed
        most = missed[:n - edits + 1]
        for _ in range(edits):
            most = np.array([(most[:k + 1] + missed[k::-1][:k + 1]).max() for k in range(n - edits + 1)])
        if most[n - edits] <= np.log(1 - RECALL):
            return r + 1
    return None


def edits_of(n: int, similarity: float) -> int:
    """Edits that an item of n words may have."""
    return int((1 - similarity) * n + 1e-9)


def with_marks(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with a mark after each row, at which walks stay, and the place of each word."""
    at = np.arange(len(w.hash)) + w.row_of_word()
    h = np.zeros(len(w.hash) + w.rows, dtype=U64)
    h[at] = w.hash
    return h, at


def walk_keys(h: np.ndarray, at: np.ndarray, repeat: int) -> np.ndarray:
    """Sampled embedding of the walk from each place ``at``."""
    samples, key = _samples(repeat).tolist(), np.zeros(len(at), dtype=U64)
    with np.errstate(over="ignore"):
        move = _moves(h, repeat, samples[-1])
        for lo in range(0, len(at), TOGETHER):
            pos, k = at[lo:lo + TOGETHER].copy(), key[lo:lo + TOGETHER]
            for step in range(samples[-1] + 1):
                if step in samples:
                    k *= U64(0x9E3779B97F4A7C15)
                    k += h[pos]
                if step < samples[-1]:
                    pos += move[step][pos]
        return mix(key + U64(repeat + 1))


def _moves(h: np.ndarray, repeat: int, steps: int) -> list[np.ndarray]:
    """For each step, whether a walk at a word goes on to the next one."""
    bits = np.where(h == 0, U64(0), mix(h ^ mix(np.array([repeat + 1], dtype=U64))[0]))
    return [((bits >> U64(step)) & U64(1)).astype(np.int64) for step in range(steps)]


def walk_reads(h: np.ndarray, at: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of words that the walk from each place ``at`` samples, and the last of its places."""
    samples = _samples(repeat).tolist()
    with np.errstate(over="ignore"):
        move = _moves(h, repeat, samples[-1])
    pos, many, before = at.copy(), np.zeros(len(at), dtype=np.int64), at - 1
    for step in range(samples[-1] + 1):
        if step in samples:
            many += pos != before
            before = pos.copy()
        if step < samples[-1]:
            pos += move[step][pos]
    return many, pos


def keys_of(w: Words, marked: tuple[np.ndarray, np.ndarray], probe: tuple[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes and keys of one chunk: of a repeat's walks, or of all pieces of so many words."""
    kind, k = probe
    if kind == "walk":
        key = walk_keys(*marked, k)
        return np.arange(len(key)), key
    at, _ = window_starts(w, k)
    return at, ngram_hashes(w.hash, k, seed=23)[at]


@dataclass
class ItemIndex:
    """Keys of the items by probe (a repeat's walks, or pieces of a number of words), and the items' word hashes."""

    ids: list
    words: list[np.ndarray]
    probes: list[tuple[str, int]]
    key: list[np.ndarray]
    item: list[np.ndarray]
    offset: list[np.ndarray]

    @classmethod
    def of(cls, ids: list, texts: list[str | None], min_words: int, similarity: float = SIMILARITY) -> "ItemIndex":
        w = split_words(pa.array(texts, type=pa.string()), lower=True, separators=NOT_ALNUM)
        words = [w.hash[w.first[r]:w.first[r + 1]] for r in range(w.rows)]
        counts = w.counts.tolist()
        repeats = np.zeros(w.rows, dtype=np.int64)
        pieces: dict[int, list[tuple[int, int]]] = {}
        for r, n in enumerate(counts):
            if n < max(min_words, 1):
                continue
            edits = edits_of(n, similarity)
            need = repeats_for(n, edits) if edits else None
            if need is not None:
                repeats[r] = need
                continue
            edge = np.linspace(0, n, min(edits + 1, n) + 1).astype(int).tolist()
            for a, b in zip(edge, edge[1:]):
                pieces.setdefault(min(b - a, LONG_PIECE), []).append((r, a))
        found = []  # probe, key, item, offset
        marked, row = with_marks(w), w.row_of_word()
        for k in range(int(repeats.max(initial=0))):
            own = np.flatnonzero(repeats[row] > k)
            key = walk_keys(marked[0], marked[1][own], k)
            many, last = walk_reads(marked[0], marked[1][own], k)
            # what a walk of few words or past the item's end reads is not the item's own
            good = (many >= LEAST) & (marked[0][last] != 0)
            found.append((("walk", k), key[good], row[own][good], (own - w.first[row[own]])[good]))
        for n, places in sorted(pieces.items()):
            item, offset = np.array(places, dtype=np.int64).T
            found.append((("piece", n), ngram_hashes(w.hash, n, seed=23)[w.first[item] + offset], item, offset))
        order = [np.argsort(f[1], kind="stable") for f in found]
        key, item, offset = ([f[k][o] for f, o in zip(found, order)] for k in (1, 2, 3))
        return cls(ids, words, [f[0] for f in found], key, item, offset)

    def masks(self) -> list[np.ndarray]:
        """For each probe, which low bits of a key occur."""
        out = []
        for k in self.key:
            m = np.zeros(1 << 18, dtype=bool)
            m[(k & U64((1 << 18) - 1)).astype(np.int64)] = True
            out.append(m)
        return out


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edit distance of the item to a stretch of the text, and the stretch (start, end)."""
    n = len(text)
    cost, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    step = np.arange(n + 1)
    for k, word in enumerate(item):
        change = cost[:-1] + (text != word)
        drop = cost + 1
        new, begin = drop.copy(), start.copy()
        better = change <= new[1:]
        new[1:][better], begin[1:][better] = change[better], start[:-1][better]
        # words of the text that the item lacks: the best way from the left
        run = new - step
        least = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == least, step, 0))
        cost, start = least + step, begin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


def scan(texts: pa.Array, index: ItemIndex, masks: list[np.ndarray], similarity: float):
    """Verified matches of one chunk: row, item, first word, words, edit distance (best of each row and item)."""
    w = split_words(texts, lower=True, separators=NOT_ALNUM)
    row, marked = w.row_of_word(), with_marks(w)
    found = []
    for r, probe in enumerate(index.probes):
        at, key = keys_of(w, marked, probe)
        hit = np.flatnonzero(masks[r][(key & U64((1 << 18) - 1)).astype(np.int64)])
        lo, hi = (np.searchsorted(index.key[r], key[hit], side=s) for s in ("left", "right"))
        many = hi - lo
        hit, lo, many = hit[many > 0], lo[many > 0], many[many > 0]
        own = np.repeat(hit, many)
        entry = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        found.append(np.stack([row[at[own]], index.item[r][entry], at[own] - index.offset[r][entry]], axis=1))
    found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    reach: dict[tuple[int, int], int] = {}
    for r, i, diagonal in found.tolist():
        item = index.words[i]
        edits = edits_of(len(item), similarity)
        if diagonal <= reach.get((r, i), -1 << 62) or best.get((r, i), (1,))[0] == 0:
            continue  # looked at with the alignment before
        reach[r, i] = diagonal + edits
        a = max(int(w.first[r]), diagonal - edits)
        b = min(int(w.first[r + 1]), diagonal + 2 * edits + len(item))
        there = set(w.hash[a:b].tolist())
        if sum(word not in there for word in item.tolist()) > edits:
            continue  # every word that is not there costs an edit
        distance, start, end = best_match(item, w.hash[a:b])
        if distance <= edits and (distance, a + start) < best.get((r, i), (1 << 62,))[:2]:
            best[r, i] = distance, a + start, end - start
    for (r, i), (distance, start, n) in sorted(best.items()):
        yield r, i, start - int(w.first[r]), n, distance


def _find(index: ItemIndex, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = index.masks()
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                got = list(scan(batch.column(1)[lo:hi], index, masks, similarity))
                if got:
                    rows, items, starts, words, distances = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[lo:hi].take(pa.array(rows)), pa.array([index.ids[i] for i in items], type=pa.int64()),
                         pa.array(starts, type=pa.int32()), pa.array(words, type=pa.int32()),
                         pa.array(distances, type=pa.int32()),
                         pa.array([len(index.words[i]) for i in items], type=pa.int32())],
                        names=["doc_id", "item_id", "start_word", "n_words", "distance", "item_words"])
    return run


def _keep_clean(index: ItemIndex, similarity: float, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = index.masks()
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for lo, hi in chunks(batch.column(text)):
                for r, *_ in scan(batch.column(text)[lo:hi], index, masks, similarity):
                    clean[lo + r] = False
            yield batch.filter(pa.array(clean))
    return run


def item_passes(items: DataFrame, min_words: int = MIN_WORDS, pass_bytes: int = PASS_BYTES,
                similarity: float = SIMILARITY) -> Iterator[ItemIndex]:
    """Indexes of the items, each over at most about ``pass_bytes`` of text: as many as the items need."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        rows = part.orderBy("item_id", "text").collect()
        yield ItemIndex.of([r["item_id"] for r in rows], [r["text"] for r in rows], min_words, similarity)


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, start_word, n_words, distance, item_words, similarity.

    An item is found where its words (runs of letters and digits, A-Z
    lower-cased) are within (1 - similarity) * item words edits of a stretch
    of the document; the stretch of the least distance is given, the first
    one of equals. Null texts, texts without words, null ids of items and
    items under ``min_words`` words match nothing; a document with a null id
    is searched. Repeated rows are searched each on their own. Empty tables
    give an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in item_passes(items, min_words, similarity=similarity):
        part = slim.mapInArrow(_find(index, similarity), "doc_id long, item_id long, start_word int, n_words int, "
                                                         "distance int, item_words int")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("similarity", 1 - F.col("distance") / F.col("item_words"))


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, unchanged, with all their columns."""
    for index in item_passes(items, min_words, similarity=similarity):
        docs = docs.mapInArrow(_keep_clean(index, similarity, docs.columns.index("text")), docs.schema)
    return docs
