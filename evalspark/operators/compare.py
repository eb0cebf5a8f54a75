"""Paired model comparison.

Alignment is an aggregation, not a join: the predictions of all models for
one (row key, actual label) are brought together as a list of (model,
prediction, count), and the registered pairs are expanded inside the row.
The prediction rows are shuffled once however many pairs there are. The list
holds models x labels entries at most, as equal predictions are counted
first: by row id within the one exchange, by text (the reference's key,
which repeats) map-side before it, so a text repeated in a third of all rows
collapses and the A x B fan-out is carried as a multiplicity instead of
emitted as row pairs.

Every statistic afterwards (contingency, McNemar, F1, bootstrap) depends on
the aligned data only through the cells (pair, actual, pred_a, pred_b, n):
at most pairs x labels^3 rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from evalspark.functions.columns import CHI2_1_CRIT_05, chi2_1_sf, r6, significance_stars
from evalspark.functions.md5 import LANES, blocks_of, md5_heads, md5_states, padded
from evalspark.operators.metrics import A, P, averages, class_stats, slice_summary
from evalspark.operators.stats import histogram
from evalspark.session import reliable_checkpoint

# Bootstrap replicates of one row of the replicate table: they share one copy of the pair's cells.
REPS_PER_BLOCK = 250

# Poisson(1) CDF at 0..5 (a weight is the number of these
# thresholds below or at u, capped at 6).
POISSON1_CDF = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)


@dataclass
class Tagged:
    """Prediction rows (model, key, actual, predicted) and the pairs to align: (pair_id, model_a, model_b)."""

    rows: DataFrame
    pairs: DataFrame


def tag_sides(predictions: DataFrame, registry: DataFrame, key: str = "row_id") -> Tagged:
    """The predictions with every pair of the registry."""
    return Tagged(predictions.select("model", key, A, P), registry.select("pair_id", "model_a", "model_b"))


def tag_two(a: DataFrame, b: DataFrame, key: str = "row_id", pair_id: int = 1) -> Tagged:
    """Two prediction frames as the sides of one pair."""
    rows = (a.select(F.lit("a").alias("model"), key, A, P)
            .unionByName(b.select(F.lit("b").alias("model"), key, A, P)))
    return Tagged(rows, a.sparkSession.createDataFrame([(pair_id, "a", "b")], "pair_id int, model_a string, model_b string"))


def _keyed(tagged: Tagged, key: str, mode: str) -> DataFrame:
    """Per (pair_id, key, actual): A/B predictions, row counts of each side and multiplicity.

    Combinations of both sides come with cnt_a = cnt_b = 0, the rows of one
    side with a null prediction of the other and n = 0.
    """
    if mode not in ("row_id", "text"):
        raise ValueError(f"unknown alignment mode {mode!r}")
    rows = tagged.rows
    if mode == "row_id":  # ids hardly repeat: nothing to gain from counting before the exchange
        rows = rows.repartition(key, A)
    counts = rows.groupBy("model", key, A, P).agg(F.count(F.lit(1)).alias("cnt"))
    lists = counts.groupBy(key, A).agg(F.collect_list(F.struct("model", P, "cnt")).alias("l"))
    # the registry is the caller's list of pairs; the pairs of the models at hand are expanded in the row
    pairs = tagged.pairs.agg(F.collect_list(F.struct("pair_id", "model_a", "model_b"))).scalar()
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast(tagged.rows.schema[P].dataType)

    def entry(pair, pred_a, pred_b, cnt_a, cnt_b, n):
        return F.struct(pair["pair_id"].alias("pair_id"), pred_a.alias("pred_a"), pred_b.alias("pred_b"),
                        cnt_a.alias("cnt_a"), cnt_b.alias("cnt_b"), n.alias("n"))

    def expand(pair):
        side_a = F.filter("l", lambda x: x["model"] == pair["model_a"])
        side_b = F.filter("l", lambda y: y["model"] == pair["model_b"])
        both = F.flatten(F.transform(side_a, lambda x: F.transform(side_b, lambda y: entry(
            pair, x[P], y[P], zero, zero, x["cnt"] * y["cnt"]))))
        only_a = F.transform(side_a, lambda x: entry(pair, x[P], none, x["cnt"], zero, zero))
        only_b = F.transform(side_b, lambda y: entry(pair, none, y[P], zero, y["cnt"], zero))
        return F.concat(both, only_a, only_b)

    return (lists.withColumn("pairs", pairs).select(key, A, F.explode(F.flatten(F.transform("pairs", expand))).alias("r"))
            .select("r.pair_id", key, A, "r.pred_a", "r.pred_b", "r.cnt_a", "r.cnt_b", "r.n"))


def aligned_rows(tagged: Tagged, key: str = "row_id", mode: str = "row_id") -> DataFrame:
    """(pair_id, key, actual_label, pred_a, pred_b, n) for keys present
    in both models; n is the number of A x B row combinations (1 when the
    key is a row id)."""
    k = _keyed(tagged, key, mode)
    k = k.where(F.col("n") > 0)
    return k.select("pair_id", key, A, "pred_a", "pred_b", F.col("n").cast("bigint").alias("n"))


def paired_cells(tagged: Tagged, key: str = "row_id", mode: str = "row_id") -> DataFrame:
    """Cells (pair_id, actual, pred_a, pred_b, n, n_a, n_b): n counts aligned
    rows; n_a / n_b count all rows of each side (the unmatched ones sit in
    cells with a null prediction of the other side). Texts are shuffled as
    128-bit hashes."""
    if mode == "text":
        hashed = tagged.rows.withColumn(key, F.unhex(F.md5(F.col(key))))
        tagged = Tagged(hashed, tagged.pairs)
    k = _keyed(tagged, key, mode)
    return k.groupBy("pair_id", A, "pred_a", "pred_b").agg(
        F.sum("n").alias("n"), F.sum("cnt_a").alias("n_a"), F.sum("cnt_b").alias("n_b"))


def paired_f1(cells: DataFrame, keys: Sequence[str] = ("pair_id",), n_col: str = "n") -> DataFrame:
    """Macro-F1 of A and B per key from paired cells (labels per side:
    actual U that side's predictions, as a per-model F1 score)."""
    keys = list(keys)
    c = cells.where(F.col("pred_a").isNotNull() & F.col("pred_b").isNotNull() & (F.col(n_col) > 0))
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("pred_a").alias(P)),
                              F.struct(F.lit("b").alias("side"), F.col("pred_b").alias(P))))
    long = c.select(*keys, A, F.col(n_col).alias("n"), sides.alias("s")).select(*keys, A, "n", "s.side", f"s.{P}")
    s = slice_summary(class_stats(long, [*keys, "side"]), [*keys, "side"])
    return s.groupBy(*keys).agg(F.max(F.when(F.col("side") == "a", F.col("f1"))).alias("f1_a"),
                                F.max(F.when(F.col("side") == "b", F.col("f1"))).alias("f1_b"))


def paired_contingency(cells: DataFrame) -> DataFrame:
    """Both correct / both wrong / only A correct (b) / only B correct (c),
    plus the row counts of each side and of the aligned set."""
    both = F.col("pred_a").isNotNull() & F.col("pred_b").isNotNull()
    ca, cb = F.col("pred_a") == F.col(A), F.col("pred_b") == F.col(A)
    n = F.col("n")

    def s(cond):
        return F.sum(F.when(both & cond, n).otherwise(0)).cast("bigint")

    return cells.groupBy("pair_id").agg(
        F.sum("n_a").cast("bigint").alias("n_a"), F.sum("n_b").cast("bigint").alias("n_b"),
        F.sum(F.when(both, n).otherwise(0)).cast("bigint").alias("n_common"),
        s(ca & cb).alias("both_correct"), s(~ca & ~cb).alias("both_wrong"),
        s(ca & ~cb).alias("b"), s(~ca & cb).alias("c"))


def mcnemar(contingency: DataFrame, with_p: bool = True) -> DataFrame:
    """C4 + C5: chi2 = (|b - c| - 1)^2 / (b + c) (0 when b + c = 0), stars,
    and optionally the p-value (1 when b + c = 0)."""
    b, c = F.col("b"), F.col("c")
    chi2 = F.when(b + c > 0, F.pow(F.abs(b - c) - 1, 2) / (b + c)).otherwise(F.lit(0.0))
    out = contingency.withColumn("chi2", chi2).withColumn("stars", significance_stars("chi2"))
    if with_p:
        out = out.withColumn("p_value", F.when(b + c > 0, chi2_1_sf(F.col("chi2"))).otherwise(F.lit(1.0)))
    return out


# ---------------------------------------------------------------- bootstrap

def _delta_f1_batch(a, pa, pb, counts):
    """Macro-F1(B) - macro-F1(A) for each row of ``counts`` (reps x cells)."""
    labels = np.unique(np.concatenate([a, pa, pb]))
    ia = np.searchsorted(labels, a)

    def macro(p):
        ip = np.searchsorted(labels, p)
        L = len(labels)
        sup_m = np.zeros((len(a), L)); sup_m[np.arange(len(a)), ia] = 1
        pred_m = np.zeros((len(a), L)); pred_m[np.arange(len(a)), ip] = 1
        tp_m = sup_m * (ia == ip)[:, None]
        tp, sup, prd = counts @ tp_m, counts @ sup_m, counts @ pred_m
        den = sup + prd
        f1 = np.divide(2 * tp, den, out=np.zeros_like(den, dtype=float), where=den > 0)
        present = den > 0
        return (f1 * present).sum(axis=1) / np.maximum(present.sum(axis=1), 1)

    return macro(pb) - macro(pa)


def _bootstrap_fn(seed: int):
    def run(batches):
        for pdf in batches:
            for pid, first, last, cells in zip(pdf["pair_id"], pdf["first"], pdf["last"], pdf["cells"]):
                a = np.array([x["a"] for x in cells]); pa = np.array([x["pa"] for x in cells])
                pb = np.array([x["pb"] for x in cells]); n = np.array([x["n"] for x in cells], dtype=float)
                probs = n / n.sum()
                reps = np.arange(first, last)
                counts = np.stack([np.random.default_rng([seed, int(pid), int(r)]).multinomial(int(n.sum()), probs)
                                   for r in reps]).astype(float)
                yield pd.DataFrame({"pair_id": np.full(len(reps), pid), "rep": reps.astype(np.int32),
                                    "delta_f1": _delta_f1_batch(a, pa, pb, counts)})
    return run


def bootstrap_delta_f1(cells: DataFrame, reps: int = 2000, seed: int = 42,
                       partitions: int | None = None) -> DataFrame:
    """Bootstrap distribution of macro-F1(B) - macro-F1(A).

    Resampling the aligned rows with replacement is exactly a multinomial
    draw over the paired cells, so each replicate costs O(cells), not O(rows).
    A row holds a block of replicates of a pair with one sorted copy of its
    cells (<= labels^3 entries); every replicate draws from a generator
    seeded by (seed, pair_id, rep), so the result depends neither on the
    order nor on the partitioning of the cells.
    """
    c = cells.where(F.col("pred_a").isNotNull() & F.col("pred_b").isNotNull() & (F.col("n") > 0))
    per_pair = c.groupBy(F.col("pair_id").cast("long").alias("pair_id")).agg(F.array_sort(F.collect_list(F.struct(
        F.col(A).cast("long").alias("a"), F.col("pred_a").cast("long").alias("pa"),
        F.col("pred_b").cast("long").alias("pb"), F.col("n").cast("long").alias("n")))).alias("cells"))
    first = F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(REPS_PER_BLOCK)))
    blocks = per_pair.select("pair_id", first.alias("first"), "cells").withColumn(
        "last", F.least(F.col("first") + REPS_PER_BLOCK, F.lit(reps)))
    keys = ["pair_id", "first"]
    blocks = blocks.repartition(partitions, *keys) if partitions else blocks.repartition(*keys)
    out = blocks.select("pair_id", "first", "last", "cells").mapInPandas(
        _bootstrap_fn(seed), "pair_id long, rep int, delta_f1 double")
    return out.withColumn("pair_id", F.col("pair_id").cast(cells.schema["pair_id"].dataType))


# Units of a text in one row, and how many of them are hashed one by one.
UNITS_PER_ROW, FEW_UNITS = 4096, 64


def poisson1_weight(u) -> F.Column:
    return sum((F.when(u >= t, 1).otherwise(0) for t in POISSON1_CDF), F.lit(0))


_THRESHOLDS = [np.uint32(math.ceil(t * 2 ** 32)) for t in POISSON1_CDF]


def _weights(heads: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of the first 32 bits of hashes."""
    out = np.zeros(heads.shape, dtype=np.uint8)
    for t in _THRESHOLDS:
        out += (heads >= t).view(np.uint8)
    return out


def _prefixes(seed: int, pair: str, reps: int, width: int) -> Iterator[tuple[int, list[bytes]]]:
    """The strings before the keys of one pair in runs of one length, ``width`` at most, with their first replicate."""
    first = 0
    while first < reps:
        last = min(reps, first + max(1, width), 10 ** len(str(first)))
        yield first, [f"{seed}:{pair}:{r}:".encode() for r in range(first, last)]
        first = last


def _row_weights(seed: int, pair: str, reps: int, keys: list[str | None], times: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums (reps, cells) of the weights of rows that lie sorted by cell, each so many ``times``."""
    out = np.zeros((reps, len(starts)), dtype=np.int64)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    for i in (i for i, key in enumerate(keys) if key is None):  # a null is left out of the string
        heads = [int(hashlib.md5(f"{seed}:{pair}:{r}".encode()).hexdigest()[:8], 16) for r in range(reps)]
        out[:, owner[i]] += _weights(np.array(heads, dtype=np.uint32)) * times[i]
    held = [(i, key.encode()) for i, key in enumerate(keys) if key is not None]
    for digits in sorted({len(str(r)) for r in range(reps)}):
        before = len(f"{seed}:{pair}:".encode()) + digits + 1
        sizes = np.array([blocks_of(len(key), before) for _, key in held])
        for size in np.unique(sizes):
            own = [held[k] for k in np.flatnonzero(sizes == size)]
            at = np.array([i for i, _ in own])
            cells, bounds = np.unique(owner[at], return_index=True)
            words, repeated = padded([key for _, key in own], before), (times[at] != 1).any()
            for first, prefixes in _prefixes(seed, pair, reps, LANES // len(own)):
                if len(str(first)) == digits:
                    w = _weights(md5_heads(prefixes, words))
                    w = w * times[at] if repeated else w
                    out[first:first + len(prefixes), cells] += np.add.reduceat(w, bounds, axis=1, dtype=np.int64)
    return out


class _UnitWeights:
    """Sums of the weights of the units of one text after another; the blocks that the units of a text share are
    hashed once for each replicate."""

    def __init__(self, seed: int, reps: int):
        self.seed, self.reps, self.last, self.begun = seed, reps, None, []

    def sums(self, pair: str, key: str | None, tail: str | None, first: int, last: int) -> np.ndarray:
        body = "".join(f"{x}:" for x in (key, tail) if x is not None).encode()
        if last - first > FEW_UNITS:
            return self._many(pair, body, [str(u).encode() for u in range(first, last + 1)])
        if self.last != (pair, key):
            text = b"" if key is None else key.encode() + b":"
            self.begun = [hashlib.md5(p + text) for _, run in _prefixes(self.seed, pair, self.reps, self.reps) for p in run]
            self.last = (pair, key)
        ends = [("" if tail is None else f"{tail}:").encode() + str(u).encode() for u in range(first, last + 1)]
        heads = bytearray()
        for begun in self.begun:
            for end in ends:
                h = begun.copy()
                h.update(end)
                heads += h.digest()[:4]
        return _weights(np.frombuffer(heads, dtype=">u4").reshape(self.reps, len(ends))).sum(axis=1, dtype=np.int64)

    def _many(self, pair: str, body: bytes, units: list[bytes]) -> np.ndarray:
        out = np.zeros(self.reps, dtype=np.int64)
        for first, prefixes in _prefixes(self.seed, pair, self.reps, self.reps):
            before = len(prefixes[0])
            done = (before + len(body)) // 64 * 64  # whole blocks that all units share
            state = None
            if done > before:
                shared = np.frombuffer(bytes(before) + body[:done - before], dtype="<u4").reshape(-1, 1)
                state = md5_states(prefixes, shared)
                rest, lead, bare = body[done - before:], 0, [b""] * len(prefixes)
            else:
                done, rest, lead, bare = 0, body, before, prefixes
            for length in sorted({len(u) for u in units}):
                own = [rest + u for u in units if len(u) == length]
                for a in range(0, len(own), LANES):
                    words = padded(own[a:a + LANES], lead, done)
                    step = max(1, LANES // words.shape[1])
                    for r in range(0, len(prefixes), step):
                        begun = None if state is None else [
                            np.repeat(s[r:r + step], words.shape[1], axis=1) for s in state]
                        heads = md5_heads(bare[r:r + step], words, begun)
                        out[first + r:first + r + len(heads)] += _weights(heads).sum(axis=1, dtype=np.int64)
        return out


def _hash_cells_fn(seed: int, reps: int, units: bool):
    """Weighted cells of a task: (pair_id, rep, actual, pred_a, pred_b, n) from rows (pair_id, actual, pred_a, pred_b,
    _pair, _key, then n; or with units _tail, _first, _last)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        known, cells = _UnitWeights(seed, reps), None
        for batch in batches:
            cells = pa.RecordBatch.from_arrays(batch.columns[:4], names=batch.schema.names[:4])
            if units:
                pairs, keys, tails, firsts, lasts = batch.columns[4:]
                for i in range(batch.num_rows):
                    own = tuple(c[i].as_py() for c in cells.columns)
                    w = known.sums(*(c[i].as_py() for c in (pairs, keys, tails, firsts, lasts)))
                    sums[own] = sums[own] + w if own in sums else w
                continue
            of = list(zip(*(c.to_pylist() for c in [*cells.columns, batch.column("_pair")])))
            place: dict[tuple, int] = {}
            cell = np.array([place.setdefault(x, len(place)) for x in of])
            groups = list(place)
            keys, times = batch.column("_key").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
            for pair in sorted({x[-1] for x in groups}):
                own = [g for g, x in enumerate(groups) if x[-1] == pair]
                at = np.concatenate([np.flatnonzero(cell == g) for g in own])
                starts = np.flatnonzero(np.append(True, np.diff(cell[at]) != 0))
                w = _row_weights(seed, pair, reps, [keys[i] for i in at], times[at], starts)
                for k, g in enumerate(own):
                    sums[groups[g][:-1]] = sums.get(groups[g][:-1], 0) + w[:, k]
        for own, w in sums.items():
            columns = [pa.array([v] * reps, type=f.type) for v, f in zip(own, cells.schema)]
            yield pa.RecordBatch.from_arrays([columns[0], pa.array(np.arange(reps, dtype=np.int32)), *columns[1:], pa.array(w)],
                                             names=["pair_id", "rep", *cells.schema.names[1:], "n"])
    return run


def bootstrap_delta_f1_hash(aligned: DataFrame, reps: int = 100, seed: int = 42, key: str = "row_id") -> DataFrame:
    """C6h: the same statistic with Poisson(1) weights from
    md5(seed:pair:rep:key), for keys that stand for several units (``n`` > 1,
    as texts do) from md5(seed:pair:rep:key:pred_a:pred_b:unit), one for
    each unit. Rows (units of a text in ranges) are dealt out; a task hashes them for all replicates
    and sums them into weighted cells, so the shuffle carries pairs x reps x
    labels^3 rows per task. Meant as the SQL-checkable variant."""
    cell = ["pair_id", A, "pred_a", "pred_b"]
    both = F.col("pred_a").isNotNull() | F.col("pred_b").isNotNull()
    x = aligned.select(*cell, F.col("pair_id").cast("string").alias("_pair"), F.col(key).cast("string").alias("_key"), "n",
                       F.when(both, F.concat_ws(":", F.col("pred_a").cast("string"), F.col("pred_b").cast("string"))).alias("_tail"))
    units = key != "row_id"
    # few bytes but much work: not left to be merged by their size
    parts = int(aligned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if units:
        first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(UNITS_PER_ROW).cast("long"))).alias("_first")
        x = x.select(*cell, "_pair", "_key", "_tail", first, "n").withColumn(
            "_last", F.least(F.col("_first") + (UNITS_PER_ROW - 1), F.col("n"))).drop("n")
        x = x.repartition(parts, "_pair", "_key", "_first").sortWithinPartitions("_pair", "_key")
    else:
        x = x.select(*cell, "_pair", "_key", "n").repartition(parts, "_pair", "_key")
    schema = StructType([x.schema["pair_id"], StructField("rep", IntegerType()), *(x.schema[c] for c in cell[1:]),
                         StructField("n", LongType())])
    cells = x.mapInArrow(_hash_cells_fn(seed, reps, units), schema)
    cells = cells.groupBy("pair_id", "rep", A, "pred_a", "pred_b").agg(F.sum("n").alias("n"))
    f = paired_f1(cells, ["pair_id", "rep"])
    return f.select("pair_id", "rep", (F.col("f1_b") - F.col("f1_a")).alias("delta_f1"))


def bootstrap_summary(deltas: DataFrame) -> DataFrame:
    """Mean, population std, 2.5 / 97.5 percentiles (linear) and the
    verdict from the CI (delta = B - A)."""
    d = F.col("delta_f1")
    s = deltas.groupBy("pair_id").agg(
        F.count(d).alias("reps"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"),
        F.percentile(d, F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"))
    lo, hi = F.col("_ci")[0], F.col("_ci")[1]
    verdict = F.when(lo > 0, "B better").when(hi < 0, "A better").otherwise("no significant difference")
    return s.select("pair_id", "reps", r6("mean").alias("delta_mean"), r6("std").alias("delta_std"),
                    r6(lo).alias("ci_lower"), r6(hi).alias("ci_upper"), verdict.alias("ci_verdict"))


def verdict(chi2, ci_lower, ci_upper) -> F.Column:
    """McNemar significant (p < .05, i.e. chi2 above the critical value)
    and a CI on one side of 0; delta is B - A, so a CI above 0 means B wins."""
    sig = chi2 > CHI2_1_CRIT_05
    return (F.when(sig & (ci_lower > 0), "B significantly better")
            .when(sig & (ci_upper < 0), "A significantly better")
            .otherwise("no significant difference"))


def compare_all(predictions: DataFrame, registry: DataFrame, reps: int = 2000, seed: int = 42,
                mode: str = "row_id", key: str = "row_id", method: str = "multinomial",
                with_p: bool = True) -> DataFrame:
    """Every registry pair in one job: counts, contingency, McNemar,
    observed F1 of both sides, bootstrap summary and verdict. A pair without
    common rows gets status 'no_common_rows' instead of failing the run."""
    tagged = tag_sides(predictions, registry, key)
    # The cells (<= pairs x labels^3 rows) feed three branches; an eager
    # reliable checkpoint computes them in one pass over the predictions.
    cells = reliable_checkpoint(paired_cells(tagged, key, mode))
    cont = mcnemar(paired_contingency(cells), with_p)
    f1 = paired_f1(cells)
    if method == "multinomial":
        deltas = bootstrap_delta_f1(cells, reps, seed)
    else:
        deltas = bootstrap_delta_f1_hash(aligned_rows(tagged, key, mode), reps, seed, key)
    summ = bootstrap_summary(deltas)
    out = (registry.select("pair_id", "model_a", "model_b", "name", "category")
           .join(cont, "pair_id", "left").join(f1, "pair_id", "left").join(summ, "pair_id", "left"))
    status = F.when(F.coalesce(F.col("n_common"), F.lit(0)) == 0, "no_common_rows").otherwise("ok")
    cols = ["pair_id", "model_a", "model_b", "name", "category", status.alias("status"),
            *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
              for c in ("n_a", "n_b", "n_common", "both_correct", "both_wrong", "b", "c")],
            r6("chi2").alias("chi2"), "stars"]
    if with_p:
        cols.append(r6("p_value").alias("p_value"))
    cols += [r6("f1_a").alias("f1_a"), r6("f1_b").alias("f1_b"), r6(F.col("f1_b") - F.col("f1_a")).alias("delta_f1"),
             "delta_mean", "delta_std", "ci_lower", "ci_upper", "ci_verdict",
             verdict(F.col("chi2"), F.col("ci_lower"), F.col("ci_upper")).alias("verdict")]
    return out.select(*cols)


def compare_models(preds: DataFrame) -> DataFrame:
    """Macro-F1 per model, ranked, best flagged (ties: model name)."""
    f = averages(preds).select("model", F.col("macro_f1"))
    # one row per model: the unpartitioned ranking window is bounded by the model count
    rank = F.row_number().over(Window.orderBy(F.col("macro_f1").desc(), F.col("model")))
    return f.select("model", "macro_f1", rank.alias("rank")).withColumn("is_best", F.col("rank") == 1)


def ablation_deltas(preds: DataFrame, reference_model: str, tol: float = 0.01) -> DataFrame:
    """Each variant's macro-F1 and its delta to the reference model,
    flagged when lower by more than ``tol``. The reference F1 is a scalar
    subquery."""
    f = averages(preds).select("model", "macro_f1")
    ref = f.where(F.col("model") == reference_model).select("macro_f1").scalar()
    d = F.col("macro_f1") - ref
    return f.select("model", "macro_f1", r6(d).alias("delta"), (d < -tol).alias("degraded"))


def bootstrap_histogram(deltas: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram of the replicate deltas per pair, with the mean, the CI
    and whether 0 lies inside it. The replicates feed several branches and
    are checkpointed once."""
    deltas = reliable_checkpoint(deltas)
    h = histogram(deltas, "delta_f1", bins, by=["pair_id"])
    s = bootstrap_summary(deltas).select("pair_id", "delta_mean", "ci_lower", "ci_upper",
                                         ((F.col("ci_lower") <= 0) & (F.col("ci_upper") >= 0)).alias("zero_inside"))
    return h.join(s, "pair_id")
