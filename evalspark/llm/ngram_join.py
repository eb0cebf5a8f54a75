"""Operator 6, n-gram Jaccard join: blocked sparse product of documents by n-grams.

The columns (n-grams) of the incidence matrix are cut into blocks, and two
documents of a size class with Jaccard similarity of at least ``percent``
differ in at most D = (a + b) (100 - percent) / (100 + percent) n-grams for their
sizes a and b. With more blocks than that, the others hold equal entries in both rows. A
document therefore knows how many non-empty blocks it shares at least with
any document it links with (blocks - its empty ones - D). Shared blocks are
accumulated over pairs, and pairs below the number are discarded
before any product. A document whose number is below one has its prefix n-grams
as keys besides; two such documents that link have one in common.

Keys of very many documents are not paired: their documents are one candidate group.
For the candidates that are left, in row blocks, overlap counts are
accumulated over the n-grams and held against the bound of their two sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.graph import components
from evalspark.llm.key_filter import KeyFilter
from evalspark.llm.staging import staged
from evalspark.llm.words import U64, chunks, mix, ngram_hashes, split_words

U32 = np.uint32
SHINGLE = 3
PERCENT = 90
SPARE = 3


@lru_cache(maxsize=None)
def size_levels(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the size classes. Sizes that can link lie in one class or in adjoining ones."""
    out, b = [], 1
    while b < top:
        out.append(b)
        b = b * 100 // percent + 1
    return np.array(out, dtype=np.int64)


@lru_cache(maxsize=None)
def block_bounds(level: int, percent: int) -> tuple[int, np.ndarray]:
    """Most differing n-grams of two linked documents of a class, and the hash ranges of its column blocks."""
    hi = int(size_levels(percent)[level + 1]) - 1
    differ = 2 * hi * (100 - percent) // (100 + percent)
    n = differ + SPARE
    n += int(3 * n * np.exp(-hi / n))  # a document of hi n-grams has a third of these empty
    return differ, np.array([(k << 64) // n for k in range(n)], dtype=U64)


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row of one chunk."""
    w = split_words(texts, lower=True)
    grams = ngram_hashes(w.hash, shingle, seed=11)
    for r in range(w.rows):
        a, b = w.first[r], w.first[r + 1]
        if b - a >= shingle:
            yield np.unique(grams[a:b - shingle + 1])
        elif b > a:  # too short: the whole text is one shingle
            yield ngram_hashes(w.hash[a:b], int(b - a), seed=100 + int(b - a))
        else:
            yield np.zeros(0, dtype=U64)


def set_id(s: np.ndarray, seed: int) -> int:
    """Hash of a set."""
    with np.errstate(over="ignore"):
        total = mix(s + U64(seed)).sum(dtype=U64)
        return int(mix(np.array([total + U64(len(s))], dtype=U64)).view(np.int64)[0])


def block_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the column blocks of a row, of its own size class and of the next one up; for each key
    the keys that it shares at least with a row it links with in that class, and whether it is of the class above."""
    levels, size = size_levels(percent), len(s)
    own = int(np.searchsorted(levels, size, side="right")) - 1
    keys, need, up = [], [], []
    with np.errstate(over="ignore"):
        sums = np.zeros(size + 1, dtype=U64)
        np.cumsum(mix(s ^ U64(0x5851F42D4C957F2D)), out=sums[1:])
        for level in (own, own + 1):
            differ, lows = block_bounds(level, percent)
            if not differ:
                continue  # only equal sets link here
            at = np.append(np.searchsorted(s, lows), size)
            full = at[1:] > at[:-1]
            block = mix((sums[at[1:]] - sums[at[:-1]]) + mix(np.arange(len(lows), dtype=U64) + U64(level << 32)))[full]
            largest = min(int(levels[level + 1]) - 1, 100 * size // percent)
            shared = len(block) - (size + largest) * (100 - percent) // (100 + percent)
            if shared < 1:  # a row it links with may share empty blocks only
                prefix = s[:size - -(-percent * size // 100) + 1]
                block = np.concatenate([block, mix(prefix ^ U64(level + 1))])
            keys.append(block)
            need.append(np.full(len(block), max(shared, 1), dtype=np.int32))
            up.append(np.full(len(block), level > own))
    if not keys:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)
    return np.concatenate(keys), np.concatenate(need), np.concatenate(up)


def _sizes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in chunks(texts):
                sets = list(shingle_sets(texts[lo:hi], shingle))
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], pa.array([len(s) for s in sets], type=pa.int64()),
                     pa.array([set_id(s, 1) if len(s) else None for s in sets], type=pa.int64())],
                    names=["doc_id", "n_shingles", "set_id"])
    return run


#: First bits of a key that name its part, and the keys that a task sorts at once. The next 32 bits are what is shuffled.
PART_BITS = 10
SORT_KEYS = 1 << 20


def _packed(keys: np.ndarray) -> pa.RecordBatch:
    """(part, keys): the leading bits of the keys, ascending in each part, as differences with their
    bytes in planes, so that the upper planes are mostly zeros."""
    lead = np.sort(keys >> U64(32 - PART_BITS))
    part = (lead >> U64(32)).astype(np.int32)
    at = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(lead))
    low = lead.astype(U32)
    return pa.RecordBatch.from_arrays(
        [pa.array(part[at[:-1]]), pa.array([np.diff(low[a:b], prepend=U32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()
                                            for a, b in zip(at, at[1:])], pa.binary())], names=["part", "keys"])


def _unpacked(packed: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(4, -1).T).view(U32)[:, 0]
    return np.cumsum(steps, dtype=U32)


def _leads(shingle: int, percent: int, firsts: KeyFilter | None):
    """(part, keys) of all texts of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for s in _sets_of(batch, shingle, firsts):
                held.append(block_keys(s, percent)[0])
                n += len(held[-1])
                if n >= SORT_KEYS:
                    yield _packed(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield _packed(np.concatenate(held))
    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leading bits (the others 0) that came more than once; rows sorted by part."""
    part, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        low = np.sort(np.concatenate([np.zeros(0, dtype=U32), *held]))
        low = np.unique(low[1:][low[1:] == low[:-1]]).astype(U64)
        if len(low):
            yield pa.RecordBatch.from_arrays([pa.array((low | U64(part << 32)) << U64(32 - PART_BITS)).view(pa.int64())], names=["key"])

    for batch in batches:
        for own, packed in zip(batch.column("part").to_pylist(), batch.column("keys")):
            if own != part:
                yield from flush()
                part, held = own, []
            held.append(_unpacked(packed.as_buffer()))
    yield from flush()


def _sets_of(batch: pa.RecordBatch, shingle: int, firsts: KeyFilter | None) -> Iterator[np.ndarray]:
    """The sets that are not empty of the texts in the first column; with a filter, of those whose second column it may hold."""
    if firsts is not None:
        batch = batch.filter(pa.array(firsts.may_hold(batch.column(1).to_numpy(zero_copy_only=False).view(U64))))
    texts = batch.column(0)
    for lo, hi in chunks(texts):
        yield from (s for s in shingle_sets(texts[lo:hi], shingle) if len(s))


def _keys(shingle: int, percent: int, repeated: KeyFilter, firsts: KeyFilter | None):
    """(key, set_id, need, up) of every text, of the keys that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], 0
            for s in _sets_of(batch, shingle, firsts):
                own = block_keys(s, percent)
                keep = repeated.may_hold(own[0])
                found.append((set_id(s, 1), [x[keep] for x in own]))
                n += int(keep.sum())
                if n >= SORT_KEYS:
                    yield table(found)
                    found, n = [], 0
            if found:
                yield table(found)

    def table(found: list) -> pa.RecordBatch:
        key, need, up = (np.concatenate([x[k] for _, x in found]) for k in range(3))
        ids = np.repeat(np.array([i for i, _ in found], dtype=np.int64), [len(x[0]) for _, x in found])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), ids, need, up)],
                                          names=["key", "set_id", "need", "up"])
    return run


def _own_texts(shingle: int):
    """Rows whose text has the set that the row names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for lo, hi in chunks(texts):
                own = [bool(len(s)) and set_id(s, 1) == i for s, i in zip(shingle_sets(texts[lo:hi], shingle), named[lo:hi])]
                yield batch.slice(lo, hi - lo).filter(pa.array(own, type=pa.bool_()))
    return run


def overlap_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of two lists of sets: a product of incidence matrices, some columns at a time."""
    own = np.concatenate(left + right)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    _, column, times = np.unique(own, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # an n-gram of one row adds nothing
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)))
    last = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, last, columns):
        a, b = np.searchsorted(column, [lo, lo + columns])
        block = np.zeros((len(left) + len(right), min(columns, last - lo)), dtype=np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        out += block[:len(left)] @ block[len(left):].T
    return out.astype(np.int64)


def _links(shingle: int, percent: int):
    """Links among the rows of one pair of row blocks: tree edges, and the number of linked documents of each row."""

    def block(key: tuple, ids: np.ndarray, part: np.ndarray, copies: np.ndarray, sets: list[np.ndarray]):
        first, second = key[1:]
        a, b = np.flatnonzero(part == first), np.flatnonzero(part == second)
        if not len(a) or not len(b):
            return
        sizes = np.array([len(s) for s in sets])
        same = overlap_counts([sets[i] for i in a], [sets[i] for i in b])
        linked = 100 * same >= percent * (sizes[a][:, None] + sizes[b][None, :] - same)
        linked &= ids[a][:, None] != ids[b][None, :]
        root = np.arange(len(ids))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, a, (linked * copies[b][None, :]).sum(axis=1))
        if first != second:
            np.add.at(links, b, (linked * copies[a][:, None]).sum(axis=0))
        for i, j in zip(*np.nonzero(linked)):
            x, y = find(a[i]), find(b[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                yield ids[a[i]], ids[b[j]], 0
        for i in np.flatnonzero(links):
            yield ids[i], None, links[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush():
            if len(held) < 2:
                return
            out = list(block(key, np.array([r[0] for r in held]), np.array([r[1] for r in held]),
                             np.array([r[2] for r in held]), [r[3] for r in held]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], type=pa.int64()) for k in range(3)], names=["a", "b", "links"])

        for batch in batches:  # sorted by group, low and high; a group may go over batches
            texts = batch.column("text")
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("candidates", "low", "high"))))
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("set_id", "part", "copies"))))
            at = 0
            for lo, hi in chunks(texts):
                for s in shingle_sets(texts[lo:hi], shingle):
                    if keys[at] != key:
                        yield from flush()
                        key, held = keys[at], []
                    held.append((*rows[at], s))
                    at += 1
        yield from flush()
    return run


#: Rows, and n-grams, of one row block of a product.
BLOCK_ROWS = 256
BLOCK_GRAMS = 500_000
#: Sets of one key that are paired; the sets of a key of more are one candidate group.
PAIR_ROWS = 64


def candidates(texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, pair_rows: int = PAIR_ROWS,
               firsts: KeyFilter | None = None) -> DataFrame:
    """(a, b): edges between the sets of ``text`` whose connected components hold every two sets that
    link. Pairs of sets that share as many keys as a link must, and the sets of the keys of more than ``pair_rows``.

    ``firsts``: a filter on a second column that one text of every set passes at least; others need not be read.
    Most keys are of one set: only the leading bits of keys are shuffled to find those that come twice (a
    key that comes again in a copy, or has the bits of another, only costs rows), and the tasks drop all others."""
    twice = staged(texts.mapInArrow(_leads(shingle, percent, firsts), "part int, keys binary").repartition("part")
                   .sortWithinPartitions("part").mapInArrow(_repeated, "key long"), "keys")
    members = staged(texts.mapInArrow(_keys(shingle, percent, KeyFilter(twice), firsts), "key long, set_id long, need int, up boolean")
                     .distinct(), "members")
    common = staged(members.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("set_id").alias("hub"))
                    .where(F.col("rows") > pair_rows).select("key", "hub"), "common-keys")
    few = (members.join(common, "key", "left_anti").groupBy("key")
           .agg(F.collect_list(F.struct("set_id", "need", "up")).alias("of")).where(F.size("of") > 1))

    def others(x):
        met = F.filter("of", lambda y: (x["set_id"] < y["set_id"]) & ~(x["up"] & y["up"]))
        return F.transform(met, lambda y: F.struct(x["set_id"].alias("a"), y["set_id"].alias("b"),
                                                   F.greatest(x["need"], y["need"]).alias("need")))

    pairs = (few.select(F.explode(F.flatten(F.transform("of", others))).alias("p")).select("p.*")
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("need").alias("need"))
             .where("shared >= need").select("a", "b"))
    return pairs.union(members.join(common, "key").select(F.col("set_id").alias("a"), F.col("hub").alias("b")))


def ngram_jaccard_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles,
    component_id, n_links.

    Texts are lower-cased (A-Z) and cut into words; a document's set holds its
    distinct ``shingle``-word shingles, or the whole text as one if it is
    shorter. Two documents link when 100 * intersection >= percent * union.
    ``component_id`` is the smallest doc_id reachable by links, ``n_links``
    the number of other documents a document links with. Documents without
    words, or with null text, have 0 shingles and no links. Rows with null
    id take no part (component null). Rows with equal ids are documents of
    their own with one name. An empty table gives an empty result.

    Equal sets are one class from the start and are never paired. Sets are
    told apart by a 64-bit hash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = staged(docs.mapInArrow(_sizes(shingle), "doc_id long, n_shingles long, set_id long"), "sets")
    classes = (sets.where("set_id is not null and doc_id is not null").groupBy("set_id")
               .agg(F.min("doc_id").alias("first_doc"), F.max("n_shingles").alias("size"),
                    F.count(F.lit(1)).alias("copies")))
    texts = docs.where("doc_id is not null and text is not null").select("text", F.xxhash64("doc_id").alias("doc"))
    firsts = KeyFilter(classes.select(F.xxhash64("first_doc").alias("key")))
    near = components(candidates(texts, shingle, percent, firsts=firsts), "a", "b")
    members = staged(near.select(F.col("node").alias("set_id"), F.col("component").alias("candidates"))
                     .join(classes, "set_id"), "candidates")
    # a row block meets every row block of its candidate group: a copy of the row for each
    blocks = members.groupBy("candidates").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int").alias("n"))
    part = F.pmod(F.xxhash64("set_id"), F.col("n")).cast("int")
    dealt = (members.join(blocks, "candidates").withColumn("part", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .select("set_id", "first_doc", "copies", "candidates", "part",
                     F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")))
    # most texts are no candidates: they are dropped before the shuffle
    wanted = KeyFilter(members.select(F.xxhash64("first_doc").alias("key")))
    texts = (wanted.keep(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("doc")), "doc").drop("doc")
             .join(members.select(F.col("first_doc").alias("doc_id"), "set_id").hint("merge"), "doc_id")
             .select("set_id", "text").mapInArrow(_own_texts(shingle), "set_id long, text string")
             # rows with equal ids: each class enters the product once, with a text of its own
             .groupBy("set_id").agg(F.min("text").alias("text")))
    products = (dealt.join(texts, "set_id").select("candidates", "low", "high", "part", "set_id", "copies", "text")
                .repartition("candidates", "low", "high").sortWithinPartitions("candidates", "low", "high"))
    links = staged(products.mapInArrow(_links(shingle, percent), "a long, b long, links long"), "links")
    linked = components(links.where("b is not null"), "a", "b").withColumnRenamed("node", "set_id")
    degree = links.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links"))
    named = (classes.join(linked, "set_id", "left").join(degree, "set_id", "left")
             .withColumn("component", F.coalesce("component", "set_id")))
    lowest = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = named.join(lowest, "component").select("set_id", "component_id", "copies", "links")
    has = F.col("s.set_id").isNotNull() & F.col("s.doc_id").isNotNull()
    return (sets.alias("s").join(named.alias("c"), F.col("s.set_id") == F.col("c.set_id"), "left")
            .select("s.doc_id", "s.n_shingles",
                    F.when(has, F.col("c.component_id")).otherwise(F.col("s.doc_id")).alias("component_id"),
                    F.when(has, F.col("c.copies") - 1 + F.coalesce("c.links", F.lit(0))).otherwise(0)
                    .cast("long").alias("n_links")))
