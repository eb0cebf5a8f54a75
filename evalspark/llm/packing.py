"""Operator 7, best-fit packing: linear grouping scheme.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens.
Only the number of pieces of each length reaches the driver (at most
``capacity`` rows), and the packing is made there for lengths, not pieces:
large lengths, in descending order, are dealt into groups of equal
cardinality and rounded up to the longest of their group; configurations of
these few sizes are chosen and applied as often as they can be; the actual
lengths take the places of the rounded ones; small lengths then go best-fit
into what is left. Rounding can cost sequences, so the scheme is planned for
several numbers of groups and bounds of a large length, the last of which
leaves all to best-fit, and the plan of the fewest sequences is taken. Pieces find their
place by their rank among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.ranking import hash_bucket, rank_in_key
from evalspark.llm.staging import staged
from evalspark.llm.words import chunks

CAPACITY = 2048
#: Plans that are compared: number of groups, and the share of a sequence above which a piece is large (from a
#: quarter on three large ones fit in a sequence at most).
SCHEMES = ((24, 0.25), (64, 0.25), (24, 0.5), (1, 1.0))
END_OF_TEXT = 0


# ---------------------------------------------------------------- tokens

#: Words whose ids a worker keeps, in each of two generations.
KEPT_WORDS = 250_000
_LOADED: dict[str, "_Encoder"] = {}
#: Between an ASCII letter or digit and an ASCII sign other than the apostrophe, either way round.
_EDGE = re.compile(rb"(?<=[a-z0-9])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[a-z0-9])")
#: Words that normalisation leaves as they are and that are one token candidate.
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Encoder:
    """Ids of texts as little-endian uint32 bytes, for byte-level tokenizers that drop white space and lower the case.

    No token goes over white space or from a letter to a sign, save that
    contractions are one token, so texts are cut there, the parts are
    encoded apart, and the ids of frequent ones are kept. Texts that may
    hold a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        """Puts the ids of all words into the young generation."""
        young, old, others = self.young, self.old, []
        for w in words.difference(young):
            if w in old:
                young[w] = old[w]
            elif w.isalpha() or _LETTERS.fullmatch(w.decode()):
                tokens = self.model.tokenize(w.decode("latin-1").translate(self.letters))
                young[w] = array("I", [t.id for t in tokens]).tobytes()
            else:
                others.append(w)
        for w, ids in zip(others, self._whole([w.decode() for w in others])):
            young[w] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        special = [i for i, t in enumerate(texts) if "<|" in t]
        for i, ids in zip(special, self._whole([texts[i] for i in special])):
            out[i] = ids
        split = [() if "<|" in t else _EDGE.sub(b" ", t.encode().lower()).split() for t in texts]
        if len(self.young) > KEPT_WORDS:
            self.young, self.old = {}, self.young
        self._learn(set().union(*split))
        ids_of = self.young.__getitem__
        return [b"".join(map(ids_of, words)) if ids is None else ids for ids, words in zip(out, split)]


def encoder(path: str) -> _Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        _LOADED[path] = _Encoder(path)
    return _LOADED[path]


def _cut(path: str, capacity: int, with_ids: bool):
    end = np.array([END_OF_TEXT], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            for lo, hi in chunks(batch.column(1)):
                rows, cols = [], [[], [], [], [], []]
                for r, ids in enumerate(encoder(path).encode([t or "" for t in batch.column(1)[lo:hi].to_pylist()])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at:at + 4 * capacity]
                        rows.append(lo + r)
                        for c, v in zip(cols, (k, at // 4, len(own) // 4, zlib.crc32(own), own)):
                            c.append(v)
                arrays = [batch.column(0).take(pa.array(rows)), pa.array(cols[0], type=pa.int32()),
                          *[pa.array(c, type=pa.int64()) for c in cols[1:4]]]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(b, dtype="<u4").astype(np.int32) for b in cols[4]],
                                           type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece (from 0), start, length, ids_crc32 (and the ids) of every piece of every row of ``docs``.

    A document is its tokens and one end id; a null text is empty. Special
    tokens are not added. The crc is over the ids as little-endian unsigned
    32-bit numbers. Rows with equal ids give pieces of their own.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_cut(tokenizer, capacity, with_ids),
                           "doc_id long, piece int, start long, length long, ids_crc32 long"
                           + ", ids array<int>" * with_ids)


# ---------------------------------------------------------------- plan

@dataclass
class Plan:
    """Places of the pieces of each length: pieces of rank lo, lo + 1, ... go ``per`` to a sequence, from
    sequence ``first`` on, one behind the other from ``offset`` on."""

    capacity: int
    length: list[int] = field(default_factory=list)
    lo: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0

    def place(self, length: int, lo: int, per: int, first: int, offset: int) -> None:
        for c, v in zip((self.length, self.lo, self.per, self.first, self.offset), (length, lo, per, first, offset)):
            c.append(v)

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def table(self) -> np.ndarray:
        """The places, ordered by length and rank, one row each."""
        t = np.array([self.length, self.lo, self.per, self.first, self.offset], dtype=np.int64).reshape(5, -1).T
        return t[np.lexsort((t[:, 1], t[:, 0]))]


class _Space:
    """Sequences by the room left in them, as ranges (room, first sequence, sequences)."""

    def __init__(self):
        self.ranges: list[tuple[int, int, int]] = []

    def add(self, room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            insort(self.ranges, (room, first, n))

    def take(self, length: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.ranges, (length, -1, -1))
        return self.ranges.pop(at) if at < len(self.ranges) else None


def _configurations(sizes: list[int], left: list[int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """Group numbers that share a sequence, and how often: the fullest one for the largest size left, until none is left."""
    while any(left):
        i = next(k for k, n in enumerate(left) if n)
        best = None
        for extra in range(3):
            for more in combinations_with_replacement(range(i, len(sizes)), extra):
                config = [i, *more]
                total = sum(sizes[k] for k in config)
                if total <= capacity and all(left[k] >= config.count(k) for k in config) and (
                        best is None or total > best[0]):
                    best = total, config
        config = best[1]
        times = min(left[k] // config.count(k) for k in config)
        for k in config:
            left[k] -= times
        yield config, times


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, schemes: Sequence[tuple[int, float]] = SCHEMES) -> Plan:
    """Packs ``counts[length]`` pieces of each length (1 to capacity): the plan of the fewest sequences (ties: the first)."""
    return min((grouping_plan(counts, capacity, *scheme) for scheme in schemes), key=lambda plan: plan.sequences)


def grouping_plan(counts: dict[int, int], capacity: int, groups: int, share: float) -> Plan:
    """The linear grouping scheme with pieces of more than ``share`` of the capacity in so many groups."""
    plan, space = Plan(capacity), _Space()
    if full := counts.get(capacity, 0):
        plan.place(capacity, 0, 1, plan.open(full), 0)
    large = sorted((n for n in counts if share * capacity < n < capacity and counts[n]), reverse=True)
    ends = np.cumsum([counts[n] for n in large])  # of each length, in descending order of all large pieces
    total = int(ends[-1]) if large else 0
    cut = max(1, -(-total // groups))
    starts = list(range(0, total, cut))
    sizes = [large[int(np.searchsorted(ends, s, side="right"))] for s in starts]
    used = list(starts)
    for config, times in _configurations(sizes, [min(cut, total - s) for s in starts], capacity):
        slots = []
        for k in config:
            slots.append(used[k])
            used[k] += times
        first = plan.open(times)
        done = 0
        while done < times:  # a stretch of instances in which every slot has one length
            at = [int(np.searchsorted(ends, s + done, side="right")) for s in slots]
            n = min(times - done, *(int(ends[k]) - s - done for k, s in zip(at, slots)))
            offset = 0
            for k, s in zip(at, slots):
                plan.place(large[k], s + done - int(ends[k]) + counts[large[k]], 1, first + done, offset)
                offset += large[k]
            space.add(capacity - offset, first + done, n)
            done += n
    for length in sorted((n for n in counts if n <= share * capacity and n < capacity), reverse=True):
        lo, left = 0, counts[length]
        while left:
            room, first, n = space.take(length) or (capacity, None, 0)
            per = room // length
            if first is None:
                n = -(-left // per)
                first = plan.open(n)
            whole = min(n, left // per)
            if whole:
                plan.place(length, lo, per, first, capacity - room)
                space.add(room - per * length, first, whole)
                lo, left = lo + whole * per, left - whole * per
            if whole < n:
                if left:  # fewer than per: the last sequence that is begun
                    plan.place(length, lo, per, first + whole, capacity - room)
                    space.add(room - left * length, first + whole, 1)
                    whole, lo, left = whole + 1, lo + left, 0
                space.add(room, first + whole, n - whole)
    return plan


# ---------------------------------------------------------------- places

def _placed(table: np.ndarray):
    key = (table[:, 0] << 40) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            at = np.searchsorted(key, (length << 40) + rank, side="right") - 1
            _, lo, per, first, offset = table[at].T
            names = [n for n in batch.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(first + (rank - lo) // per),
                 pa.array(offset + (rank - lo) % per * length)], names=[*names, "sequence_id", "offset"])
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, schemes: Sequence[tuple[int, float]] = SCHEMES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length, and any other columns).

    Sequences hold at most ``capacity`` tokens, gapless from offset 0.
    ``pieces`` is read twice; give it a written table. Lengths must lie in 1
    to capacity. An empty table gives an empty result. Ranks are exact below
    2^40 pieces of one length. Input columns named sequence_id or offset are
    replaced. Pieces of one length with equal ids and piece numbers follow
    their start and ids_crc32, where they have them.
    """
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    hashed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece")))
    ties = [c for c in ("start", "ids_crc32") if c in pieces.columns]
    ranked = rank_in_key(pieces.withColumn("__h", hashed).withColumn("__b", hash_bucket(F.col("__h"))),
                         "length", "__b", ["__h", *ties], "__rank", "__total")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*(F.col(f"`{c}`") for c in pieces.columns), "__rank").mapInArrow(
        _placed(plan_packing(counts, capacity, schemes).table()), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset.

    Documents longer than ``capacity`` are cut into full pieces and a rest;
    no other document is cut. Null and empty texts are one piece of length 1
    (the end id).
    """
    return pack(staged(tokenized_pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)
