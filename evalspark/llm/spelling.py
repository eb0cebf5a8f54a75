"""Operator 13, spelling variant grouping by a dictionary of pairs of trie nodes.

The prefixes of the words are the nodes of a trie, their suffixes those of the
trie of the reversed words. A node's number comes from its parent's and the letter
between them, so tasks agree on the numbers without a common table. A word v
with the position i skipped is the pair (node of v[:i], node of v[i+1:]); v itself, with a
letter to be inserted at i, is the pair (node of v[:i], node of v[i:]). Words
that meet in a pair by skips on both sides differ in the letter at i only; a skip that meets
an insertion place is one letter longer. These are all the words at edit
distance one, each found once (a repeated letter is skipped at its last place only).

A pair has at most one word by insertion and, by skips, one word for each letter
of the alphabet, so the rows of a pair are bounded by the alphabet whatever
the corpus. Words are counted by partial aggregates; a hot word is one row a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.staging import staged
from evalspark.llm.words import U64, mix

MIN_LETTERS = 6
MIN_COUNT = 5
FACTOR = 5
#: A word is a run of these letters; only A-Z have a lower case here.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the pair dictionary: the word itself, a letter skipped, a letter skipped that differs from the next.
WHOLE, SKIPPED, LAST_SKIPPED = 0, 1, 2
_FORWARD, _BACKWARD = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def letter_runs(docs: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(doc_id, word) for every run of at least ``min_letters`` letters of every whole text; null text: none."""
    run = F.col("run")
    runs = (docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"))
            .where(F.char_length("run") >= min_letters))
    return runs.select("doc_id", F.when(F.lower(run) == run, run).otherwise(F.translate(run, UPPER, LOWER)).alias("word"))


def skip_letters(runs: DataFrame, every: int = 199) -> DataFrame:
    """``runs`` with one letter left out where ``every`` divides h = crc32 of ``<doc_id>:<word>``: the
    one at h % length. Rows with a null id stay as they are."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    at = (h % F.char_length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
    return runs.withColumn("word", F.when(h % every == 0, cut).otherwise(F.col("word")))


def count_words(runs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of at least so many letters with at least so many occurrences."""
    return (runs.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def node_numbers(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the trie nodes of all prefixes and of all suffixes of the words, one after the other (a
    word of L letters has L + 1 of each); the first node of each word; the letters."""
    length = np.array([len(x) for x in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(U64)
    letter0 = np.cumsum(length) - length
    node0 = letter0 + np.arange(len(words))
    before = np.full(int(length.sum()) + len(words), U64(1), dtype=U64)
    behind = np.full(len(before), U64(2), dtype=U64)
    order = np.argsort(-length, kind="stable")
    with np.errstate(over="ignore"):
        for k in range(int(length.max(initial=0))):
            own = order[:np.searchsorted(-length[order], -k, side="left")]  # words of more than k letters
            at, lo = node0[own], letter0[own]
            before[at + k + 1] = mix(before[at + k] + (letters[lo + k] + U64(1)) * _FORWARD)
            end = at + length[own] - k
            behind[end - 1] = mix(behind[end] + (letters[lo + length[own] - k - 1] + U64(1)) * _BACKWARD)
    return before, behind, node0, letters


def _pairs(batches: Iterator[pa.RecordBatch], chunk: int = 200_000) -> Iterator[pa.RecordBatch]:
    """word -> the rows of the pair dictionary: prefix node, suffix node, the word's own node, kind."""
    for batch in batches:
        held, letters = [], 0
        for word in [*batch.column(0).to_pylist(), None]:
            if word is not None:
                held.append(word)
                letters += len(word)
            if held and (word is None or letters > chunk):
                yield _pair_rows(held)
                held, letters = [], 0


def _pair_rows(words: list[str]) -> pa.RecordBatch:
    before, behind, node0, letters = node_numbers(words)
    length = np.array([len(x) for x in words], dtype=np.int64)
    own = before[node0 + length]  # the whole word is a node too
    of = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(letters)) + of  # node before each letter
    last = np.ones(len(letters), dtype=bool)
    last[:-1] = (letters[1:] != letters[:-1]) | (of[1:] != of[:-1])
    cols = [np.concatenate([before, before[at]]), np.concatenate([behind, behind[at + 1]]),
            np.concatenate([np.repeat(own, length + 1), own[of]])]
    kind = np.concatenate([np.full(len(before), WHOLE), np.where(last, LAST_SKIPPED, SKIPPED)]).astype(np.int8)
    return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in cols), pa.array(kind)],
                                      names=["prefix_node", "suffix_node", "node", "kind"])


def near_words(words: DataFrame) -> DataFrame:
    """(node, near): every two of the distinct ``word`` at edit distance one, in both directions, by their trie nodes."""
    rows = words.select("word").mapInArrow(_pairs, "prefix_node long, suffix_node long, node long, kind byte")
    met = (rows.groupBy("prefix_node", "suffix_node").agg(F.collect_list(F.struct("node", "kind")).alias("of"))
           .where((F.size("of") > 1)))

    def neighbours(a):
        def near(b):
            skips = (a["kind"] > WHOLE) & (b["kind"] > WHOLE)
            return (a["node"] != b["node"]) & (skips | (F.abs(a["kind"] - b["kind"]) == LAST_SKIPPED - WHOLE))
        return F.transform(F.filter("of", near), lambda b: F.struct(a["node"].alias("node"), b["node"].alias("near")))

    return met.select(F.explode(F.flatten(F.transform("of", neighbours))).alias("p")).select("p.node", "p.near")


def spelling_groups(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """One row per row of ``words`` (word, n; distinct words): word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or
    replaced letter; ``n_near`` counts a word's near words. ``form`` is the
    near word of largest n (ties: smallest in code-point order) if that n is
    at least ``factor`` times the word's own, else null, with ``form_n`` its n;
    ``root`` is reached by following forms to the last, the word itself if
    it has none. Rows with a null word or n are left out; an empty word has no
    letters to skip but is near to all words of one letter. An empty table gives an empty
    result. Words and nodes are told apart by 64-bit numbers.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, else forms could go in a circle")
    words = words.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n"))
    numbered = staged(words.mapInArrow(_own_nodes, "word string, n long, node long"), "spelling-words")
    near = near_words(numbered).join(numbered.select(F.col("node").alias("near"), F.col("word").alias("other"),
                                                     F.col("n").alias("other_n")), "near")
    best = near.groupBy("node").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    large = -F.col("best.less") >= factor * F.col("n")
    out = staged(numbered.join(best, "node", "left")
                 .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(large, F.col("best.other")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")),
                 "spelling-forms")
    top, low = out.agg(F.max("n"), F.min("n")).first()
    # a step multiplies n by factor, so this bounds the steps; each round doubles the steps taken
    steps = int(math.log(max(top or 1, 1) / max(low or 1, 1), factor) + 1e-9) if top else 0
    up = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(steps - 1, 0).bit_length()):
        beyond = up.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        up = staged(up.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots")
    return (out.join(up, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def _own_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of each word's node in the forward trie."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 10_000):
            part = batch.slice(lo, 10_000)
            words = part.column(0).to_pylist()
            before, _, node0, _ = node_numbers(words)
            own = before[node0 + np.array([len(x) for x in words], dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.view(np.int64))],
                                             names=["word", "n", "node"])
