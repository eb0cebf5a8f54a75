"""Exact quantiles by radix selection: histograms of the ordered bits of the values, refined pass by pass.

A double is mapped to a long of the same order. The first pass counts the values of a group by the upper
16 bits, each further pass counts only the values in the buckets that hold a wanted rank by 16 bits more;
four passes reach the value itself. Counts are formed map-side, so a task or buffer holds at most 65,536
counters of a group and never its values, and a group with most rows is no more work for one task than others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import reliable_checkpoint

#: Bits that are cut off in each pass.
SHIFTS = (48, 32, 16, 0)
#: Buckets that hold wanted ranks are broadcast up to this number (some 10 MB), else met by a shuffled join.
MAX_BROADCAST_BUCKETS = 100_000

_MANTISSA = 1 << 52
_INFINITY = 2047 << 52
_NAN = _INFINITY + 1


def ordered_bits(x: Column) -> Column:
    """A long with the order of the double: its IEEE 754 bits, negated for negative values; both zeros give
    0, NaN comes after infinity, as Spark orders them. Arithmetic by powers of two only, so it is exact."""
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    a = F.when(finite, F.abs(x)).otherwise(F.lit(1.0))
    guess = F.coalesce(F.floor(F.log2(a)), F.lit(-1022))
    e = F.greatest(F.lit(-1022), F.least(F.lit(1023), guess))
    m = a / F.pow(F.lit(2.0), e)
    e = e + F.when(m >= 2, 1).when((m < 1) & (e > -1022), -1).otherwise(0)
    m = a / F.pow(F.lit(2.0), e)
    bits = (e + 1022).cast("long") * F.lit(_MANTISSA) + (m * float(_MANTISSA)).cast("long")
    bits = F.when(F.isnan(x), F.lit(_NAN)).when(~finite, F.lit(_INFINITY)).otherwise(bits)
    return F.when(x < 0, -bits).otherwise(bits)


def from_ordered_bits(bits: Column) -> Column:
    """The double of :func:`ordered_bits`."""
    b = F.abs(bits)
    e = F.greatest(F.lit(1), F.least(F.lit(2046), F.shiftright(b, 52)))
    v = (b - (e - 1).cast("long") * F.lit(_MANTISSA)).cast("double") * F.pow(F.lit(2.0), e - 1075)
    v = F.when(b == _NAN, F.lit(float("nan"))).when(b == _INFINITY, F.lit(float("inf"))).otherwise(v)
    return F.when(bits < 0, -v).otherwise(v)


def _beside(rows: DataFrame, buckets: DataFrame, n_buckets: int, keys: list[str], *cols: str) -> DataFrame:
    """The rows with a bucket of the same keys (null-safe) and the named columns of it."""
    right = buckets.select(*[F.col(c).alias(f"_right{c}") for c in (*keys, *cols)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right{k}")) for k in keys])
    if n_buckets <= MAX_BROADCAST_BUCKETS:
        right = F.broadcast(right)
    return rows.join(right, same).select(*rows.columns, *[F.col(f"_right{c}").alias(c) for c in cols])


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))


def _below(within: list[str]) -> Column:
    """Values of smaller digits in the same bucket; at most 65,536 digits are ordered together."""
    w = Window.partitionBy(*within).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum("_n").over(w) - F.col("_n")


def _hits(counted: DataFrame, by: list[str]) -> DataFrame:
    """One row for each wanted rank (``_want``: rank and rest, the rank within the bucket above), with its
    bits where the bucket decides them: at its ends or if all its values are equal."""
    rest = F.filter("_want", lambda w: (w["rest"] >= F.col("_below")) & (w["rest"] < F.col("_below") + F.col("_n")))
    hit = counted.select(*by, "_total", F.col("_d").alias("_p"), "_n", "_lo", "_hi", "_below", F.explode(rest).alias("_w"))
    rest = F.col("_w.rest") - F.col("_below")
    bits = F.when(rest == 0, F.col("_lo")).when(rest == F.col("_n") - 1, F.col("_hi")).when(
        F.col("_lo") == F.col("_hi"), F.col("_lo"))
    return hit.select(*by, "_total", "_p", F.col("_w.rank").alias("_rank"), rest.alias("_rest"), bits.alias("_bits"))


def order_statistics(df: DataFrame, col: str, ranks, by: Sequence[str] = ()) -> DataFrame:
    """The values of the given ranks of each group's non-null values: ``by``, ``n``, ``rank`` (from 0), ``value``.

    ``ranks`` makes an array column of ranks from the column of a group's number of values; ranks outside
    it give no row. Null groups are groups; a group without values has no rows. The input is read once for
    each pass, of which groups of few or few different values need fewer than four.
    """
    by = list(by)
    keys = df.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col(col).cast("double").alias("_x"))
    names = [f"_b{i}" for i in range(len(by))]
    keys = keys.where(F.col("_x").isNotNull()).select(*names, ordered_bits(F.col("_x")).alias("_k"))

    digits = _counted(keys.withColumn("_d", F.shiftright("_k", SHIFTS[0])), [*names, "_d"])
    total = F.sum("_n").over(Window.partitionBy(*names))
    digits = digits.select("*", total.alias("_total"), _below(names).alias("_below"))
    want = F.transform(F.array_distinct(ranks(F.col("_total"))),
                       lambda r: F.struct(r.cast("long").alias("rank"), r.cast("long").alias("rest")))
    found = reliable_checkpoint(_hits(digits.withColumn("_want", want), names))
    done = [found.where("_bits is not null")]
    for last, shift in zip(SHIFTS, SHIFTS[1:]):
        buckets = found.where("_bits is null").groupBy(*names, "_p").agg(
            F.first("_total").alias("_total"), F.collect_list(F.struct(F.col("_rank").alias("rank"),
                                                                      F.col("_rest").alias("rest"))).alias("_want"))
        n_buckets = buckets.count()
        if n_buckets == 0:
            break
        inner = [*names, "_p"]
        rows = _beside(keys.withColumn("_p", F.shiftright("_k", last)), buckets, n_buckets, inner)
        counted = _counted(rows.withColumn("_d", F.shiftright("_k", shift)), [*inner, "_d"])
        counted = counted.withColumn("_below", _below(inner))
        found = reliable_checkpoint(_hits(_beside(counted, buckets, n_buckets, inner, "_total", "_want"), names))
        done.append(found.where("_bits is not null"))
    out = reduce(DataFrame.unionByName, done)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, by)], F.col("_total").alias("n"),
                      F.col("_rank").alias("rank"), from_ordered_bits(F.col("_bits")).alias("value"))


def attach_null_safe(rows: DataFrame, per_group: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """The rows with a written group table's columns, null groups included; without groups the one row's values are scalars."""
    if not by:
        return rows.select("*", *[per_group.select(c).scalar().alias(c) for c in cols])
    return _beside(rows, per_group, per_group.count(), by, *cols)


def exact_quantiles(df: DataFrame, col: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``n`` (non-null values) and ``quantiles``, an array in the order of ``at``: linear
    interpolation between the two neighbouring values, as ``percentile`` has it. Every group with a value
    gives a row."""
    by = list(by)
    names = [f"_b{i}" for i in range(len(by))]

    def ends(n):
        return F.array(*[f(F.lit(float(q)) * (n - 1)).cast("long") for q in at for f in (F.floor, F.ceil)])

    keyed = df.select(*[F.col(c).alias(n) for n, c in zip(names, by)], F.col(col).alias("_v"))
    stats = order_statistics(keyed, "_v", ends, names)
    per = stats.groupBy(*names, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))

    def value(q):
        pos = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
        a, b = F.element_at("_at", lo), F.element_at("_at", hi)
        return F.when(a == b, a).otherwise((hi - pos) * a + (pos - lo) * b)

    return per.select(*[F.col(n).alias(c) for n, c in zip(names, by)], "n",
                      F.array(*[value(q) for q in at]).alias("quantiles"))
