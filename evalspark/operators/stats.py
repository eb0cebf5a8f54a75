"""Distributions and dataset statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.columns import r6
from evalspark.operators.quantiles import attach_null_safe, exact_quantiles
from evalspark.session import reliable_checkpoint


def _attach(rows: DataFrame, per_key: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Attach per-key statistics to rows: an equi-join on the keys, or, with
    no keys, scalar subqueries (one value each) instead of a cross join."""
    if by:
        return rows.join(per_key, by)
    return rows.select("*", *[per_key.select(c).scalar().alias(c) for c in cols])


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """A1: count per value, ordered by (count desc, value) with a distributed
    range sort (no single-partition ranking window). Null values are left
    out, as in a pandas value count."""
    by = list(by)
    c = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    return c.select(*by, F.col(col).alias("value"), "n").orderBy(*by, F.col("n").desc(), F.col("value"))


def value_shares(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """A2: percentage per value; with ``top`` the share is within the top values.

    The denominator is a scalar subquery (one number), so the counted values
    stay distributed instead of meeting in one window partition.
    """
    c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if top is not None:
        c = c.orderBy(F.col("n").desc(), F.col(col)).limit(top)
    total = c.select(F.sum("n")).scalar()
    return c.select(F.col(col).alias("value"), "n", r6(F.col("n") * 100.0 / total).alias("pct"))


def distinct_count(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """A3: exact number of distinct non-null values."""
    return df.groupBy(*by).agg(F.count_distinct(col).alias("n_distinct"))


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """A5: equal-width histogram over [min, max] with the last bin closed
    (max falls into the last bin); a constant series spans min +- 0.5.
    All bins are returned, empty ones with count 0."""
    by = list(by)
    x = F.col(col).cast("double")
    rng = df.groupBy(*by).agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    rng = rng.select(*by, F.when(F.col("_mx") == F.col("_mn"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
                     F.when(F.col("_mx") == F.col("_mn"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"))
    j = _attach(df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull()), rng, by, ["lo", "hi"])
    idx = F.least(F.floor((F.col("_x") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))),
                  F.lit(bins - 1)).cast("int")
    counts = j.groupBy(*by, idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    allb = rng.select(*by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    allb = allb.select(*by, "bin", r6(F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                       r6(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"))
    out = allb.join(counts, [*by, "bin"], "left")
    return out.select(*by, "bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def five_number(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles (linear interpolation), IQR, whiskers at 1.5 IQR and the
    outlier count. Quartiles come from radix selection, so columns and groups
    of any size do; a group without values has no row, null groups are a group."""
    by = list(by)
    names = [f"_b{i}" for i in range(len(by))]
    base = df.select(*[F.col(c).alias(n) for n, c in zip(names, by)], F.col(col).cast("double").alias("_x"))
    base = base.where(F.col("_x").isNotNull())
    # written, for the quartiles are joined to the rows by size
    q = reliable_checkpoint(exact_quantiles(base, "_x", (0.25, 0.5, 0.75), names))
    q = q.select(*names, *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    measures = ["q1", "median", "q3", "iqr"]
    s = attach_null_safe(base, q, names, measures).groupBy(*names, *measures).agg(
        F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("whisker_hi"),
        F.count(F.when((F.col("_x") < lo_f) | (F.col("_x") > hi_f), 1)).alias("n_outliers"))
    return s.select(*[F.col(n).alias(c) for n, c in zip(names, by)],
                    *[r6(c).alias(c) for c in (*measures, "whisker_lo", "whisker_hi")], "n_outliers")


def quantiles(df: DataFrame, col: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """A6 for any quantiles: ``by``, ``n``, ``q`` and its exact ``value``, one row for each quantile."""
    x = exact_quantiles(df, col, at, by)
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(float(q)) for q in at]).alias("q"), F.col("quantiles").alias("value")))
    return x.select(*by, "n", pairs.alias("_p")).select(*by, "n", F.col("_p.q").alias("q"), r6("_p.value").alias("value"))


def dataset_stats(combined: DataFrame, origin_col: str = "origin") -> DataFrame:
    """A4: rows per origin (original / neutral / unrelated) and the yield of
    the generation step, in one conditional aggregate."""
    o = F.col(origin_col)
    s = combined.agg(F.count_if(o == "original").alias("n_original"),
                     F.count_if(o == "neutral").alias("n_neutral"),
                     F.count_if(o == "unrelated").alias("n_unrelated"),
                     F.count(F.lit(1)).alias("n_total"))
    return s.select("*", r6(F.col("n_neutral") / F.col("n_original")).alias("neutral_yield"),
                    r6(F.col("n_unrelated") / F.col("n_original")).alias("unrelated_yield"))
