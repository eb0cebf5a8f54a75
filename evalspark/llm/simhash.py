"""Operator 12, SimHash near-duplicates: segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of its
segments are its place in a space where the Manhattan distance of two
fingerprints is never above their Hamming distance. Written in unary (a count of
one as 01, of two as 11) the counts are a 64-bit word again, and the Manhattan
distance is the number of bits in which two such words differ.

The 32 coordinates lie in distance + 3 groups. Two places within the Manhattan
distance agree in three groups at least, so they share a cell of the grid that
is projected onto these three; there is one such grid for every choice of three
(35 for distance 4), with about 20 bits of a cell each. In each cell places are joined
by Manhattan distance, and what is left is verified on the fingerprints.

Equal fingerprints are one node from the start (copies and texts without words never meet).
A cell gives the edges of a forest, not its pairs, and a cell of many
fingerprints is cut into row blocks of which each two meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.graph import components
from evalspark.llm.staging import staged
from evalspark.llm.words import U64, chunks, split_words

SHINGLE = 4
DISTANCE = 4
SEED = 42
AGREE = 3
SEGMENTS = 32
#: Fingerprints of a cell that one task compares; more are cut into row blocks.
BLOCK_ROWS = 16_384
_LOW = 0x5555555555555555


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of each row of one chunk: the majority of each bit over the XXH64 values of its shingles."""
    from xxhash import xxh64_intdigest

    w = split_words(texts, lower=True)
    out = np.zeros(w.rows, dtype=U64)
    counts = w.counts
    if not len(w.hash):
        return out
    # words of all rows joined by one space: every shingle is a slice
    joined = b" ".join(w.data.tobytes().split())
    end = np.cumsum(w.end - w.start + 1) - 1
    start = end - (w.end - w.start)
    spans = np.maximum(counts - shingle + 1, np.minimum(counts, 1))  # shingles of each row
    has = np.flatnonzero(spans)
    begin = np.cumsum(spans[has]) - spans[has]
    first = np.repeat(w.first[has] - begin, spans[has]) + np.arange(int(spans.sum()))
    last = first + np.repeat(np.minimum(counts[has], shingle), spans[has]) - 1
    h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist())], dtype="<u8")
    step = 1 << 16  # shingles whose bits are laid out at a time
    ones = np.zeros((w.rows, 64), dtype=np.int64)
    row = np.repeat(has, spans[has])
    for lo in range(0, len(h), step):
        bits = np.unpackbits(h[lo:lo + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = row[lo:lo + step]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    set_ = 2 * ones > spans[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").reshape(-1).astype(U64)


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in chunks(texts):
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], pa.array(fingerprints(texts[lo:hi], shingle, seed).view(np.int64))], names=["doc_id", "fp"])
    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 32 segments, each in unary in its own two bits."""
    shifted = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(shifted).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(shifted).bitwiseAND(F.lit(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def counts_of(fp: np.ndarray) -> np.ndarray:
    """As ``segment_counts``, in a task."""
    low, one = U64(_LOW), U64(1)
    return ((fp | (fp >> one)) & low) | ((fp & (fp >> one) & low) << one)


def grid_masks(distance: int, agree: int = AGREE) -> list[int]:
    """The bits of the coordinates of each projected grid."""
    groups = distance + agree
    bounds = [SEGMENTS * k // groups for k in range(groups + 1)]
    own = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(bounds, bounds[1:])]
    return [sum(own[k] for k in chosen) for chosen in combinations(range(groups), agree)]


def grid_cells(fps: DataFrame, distance: int) -> DataFrame:
    """(cell, fp): the cell of every fingerprint in every projected grid."""
    place = fps.select("fp", segment_counts(F.col("fp")).alias("place"))
    cells = [F.xxhash64(F.lit(k), F.col("place").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(grid_masks(distance))]
    return place.select(F.explode(F.array(*cells)).alias("cell"), "fp")


def cell_links(group: np.ndarray, fp: np.ndarray, distance: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked within each group (rows of a group lie together)."""
    place = counts_of(fp)
    size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group)))
    begin = np.cumsum(size) - size
    few = np.repeat(size <= small, size)
    lefts, rights = [], []
    for d in range(1, small):  # small cells: every two rows, all cells at once
        a = np.flatnonzero(few[:-d] & (group[d:] == group[:-d])) if d < len(group) else np.zeros(0, dtype=np.int64)
        if not len(a):
            break
        a = a[np.bitwise_count(place[a] ^ place[a + d]) <= distance]
        a = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= distance]
        lefts.append(a)
        rights.append(a + d)
    for k in np.flatnonzero(size > small):  # others: a search that leaves what it has reached
        left = np.arange(begin[k], begin[k] + size[k])
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.flatnonzero(np.bitwise_count(place[left] ^ place[x]) <= distance)
                near = near[np.bitwise_count(fp[left[near]] ^ fp[x]) <= distance]
                if len(near):
                    found = left[near]
                    lefts.append(np.full(len(found), x))
                    rights.append(found)
                    queue.extend(found.tolist())
                    left = np.delete(left, near)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def _links(distance: int):
    def edges(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = cell_links(group, fp, distance)
        return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, seen, last = [], [], 0, None  # rows of the cells that are not complete yet
        for batch in batches:  # sorted by cell, low and high; a cell may go over batches
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "low", "high")], axis=1)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(U64)
            if not len(fp):
                continue
            new = np.concatenate([[last is None or (key[0] != last).any()], (key[1:] != key[:-1]).any(axis=1)])
            number = seen + np.cumsum(new)
            seen, last = int(number[-1]), key[-1]
            done = int(np.searchsorted(number, number[-1]))  # rows before the last cell of the batch
            if done or new[0]:
                whole = (np.concatenate([*keys, number[:done]]), np.concatenate([*fps, fp[:done]]))
                if len(whole[0]) > 1:
                    yield edges(*whole)
                keys, fps = [], []
            keys.append(number[done:])
            fps.append(fp[done:])
        if keys:
            yield edges(np.concatenate(keys), np.concatenate(fps))
    return run


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): edges between the distinct fingerprints ``fp`` that connect all those linked by
    ``distance`` or fewer differing bits; not all the links."""
    cells = grid_cells(fps, distance)
    # few cells are so full: a small table, whose size is known when the join is planned
    full = staged(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block_rows)
                  .select("cell", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks")), "simhash-full")
    part = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # a row block meets every other block of its cell; a cell of one block stays as it is
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("part")))
    dealt = (cells.join(full, "cell", "left").withColumn("part", part)
             .select("cell", "fp", "part", F.explode(others).alias("other"))
             .select("cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp")
             .repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high"))
    return dealt.mapInArrow(_links(distance), "a long, b long")


def simhash_near_dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, fingerprint
    (16 lowercase hex digits), component_id.

    Texts are lower-cased (A-Z) and cut into words; the fingerprint takes the
    majority of each bit over the XXH64 values (seed 42) of all ``shingle``-word
    shingles, repeats included; a shorter text is one shingle. A text without words, or null,
    has fingerprint zero and links like any other. Two documents link when their fingerprints differ in
    ``distance`` bits or fewer; ``component_id`` is the smallest doc_id
    reachable by links, its own included. A row with a null id takes no part and has a
    null component. Rows with equal ids are documents of their own with one
    name. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(docs.mapInArrow(_fingerprints(shingle, SEED), "doc_id long, fp long"), "simhash-rows")
    nodes = staged(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-nodes")
    linked = components(fingerprint_links(nodes.select("fp"), distance, block_rows), "a", "b")
    named = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    # written, so that the join by fingerprint meets plain exchanges and a fingerprint of very many copies can be split
    named = staged(named.join(lowest, "component").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
