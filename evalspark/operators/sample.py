"""Exact, deterministic sampling and splitting (SA1-SA5, P17).

Row order within a stratum is md5(seed ':' key), then the key. Sizes follow
the stratified rule: n_test = ceil(fraction x N); each stratum gets
floor(n_test x N_c / N) and the remaining rows go to the largest remainders
(ties: smaller stratum value first).

No stratum is sorted as a whole. Rows are bucketed by the first 16 bits of
their hash; counts per (stratum, bucket) (<= 65,536 rows per stratum) give
each stratum's cut bucket; only rows of the cut bucket are ranked, every
other row is decided by comparing its bucket with the cut. The cuts, one per
stratum, are worked out first and written (one job); they reach the rows as a map held in
a scalar subquery over that one row, so no row is shuffled by its stratum but
those of the cut buckets, and a sample of a sample holds no nested subquery. Null strata
form a stratum of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.columns import hash_key
from evalspark.session import reliable_checkpoint

_BUCKET_HEX = 4


def _with_hash(df: DataFrame, key: str, seed) -> DataFrame:
    h = hash_key(seed, key)
    return df.withColumn("_h", h).withColumn(
        "_bk", F.conv(F.substring("_h", 1, _BUCKET_HEX), 16, 10).cast("int"))


def _stratum_key(strata: str) -> F.Column:
    """The stratum as a map key: null is told from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(strata).cast("string")), F.lit(""))


def stratum_quotas(counts: DataFrame, strata: str, total) -> DataFrame:
    """Per stratum: N_c and its quota of ``total`` rows (largest remainders).

    ``counts`` has one row per (stratum, bucket); ``total`` is a Column of
    the wanted number of rows given N (column ``_N``). Products are decimal,
    as T x N_c leaves the range of a long near 7 billion rows."""
    per = counts.groupBy(strata).agg(F.sum("_cnt").alias("_Nc"))
    w_all = Window.partitionBy()  # one row per stratum
    per = per.withColumn("_N", F.sum("_Nc").over(w_all))
    per = per.withColumn("_T", total)
    num = F.col("_T").cast("decimal(19,0)") * F.col("_Nc").cast("decimal(19,0)")
    big_n = F.col("_N").cast("decimal(19,0)")
    per = per.withColumn("_rem", num % big_n)
    per = per.withColumn("_fl", ((num - F.col("_rem")) / big_n).cast("long"))
    per = per.withColumn("_left", F.col("_T") - F.sum("_fl").over(w_all))
    rk = F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(strata).asc_nulls_first()))
    return per.withColumn("_quota", F.col("_fl") + F.when(rk <= F.col("_left"), 1).otherwise(0)) \
              .select(strata, "_Nc", "_quota")


def _pick(df: DataFrame, strata: str, key: str, seed, quotas) -> DataFrame:
    """df with boolean ``_picked``: the first quota rows of each stratum in hash order.

    ``quotas`` makes (stratum, _quota) from the counts per (stratum, bucket)."""
    x = _with_hash(df, key, seed)
    counts = x.groupBy(strata, "_bk").agg(F.count(F.lit(1)).alias("_cnt"))
    per = quotas(counts).select(F.col(strata).alias("_s"), "_quota")
    w = Window.partitionBy(strata).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    cum = counts.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    cut = cum.join(per, F.col(strata).eqNullSafe(F.col("_s"))).where(
        (F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_before") + F.col("_cnt")))
    cuts = reliable_checkpoint(cut.agg(F.map_from_entries(F.collect_list(F.struct(_stratum_key(strata), F.struct(
        F.col("_bk").alias("cut"), (F.col("_quota") - F.col("_before")).alias("need")))).alias("cuts")))).scalar()
    j = x.withColumn("_c", F.try_element_at(cuts, _stratum_key(strata)))
    at_cut = F.coalesce(F.col("_bk") == F.col("_c.cut"), F.lit(False))
    decided = j.where(~at_cut).withColumn("_picked", F.coalesce(F.col("_bk") < F.col("_c.cut"), F.lit(False)))
    rn = F.row_number().over(Window.partitionBy(strata, "_bk").orderBy("_h", key))
    ranked = j.where(at_cut).withColumn("_picked", rn <= F.col("_c.need"))
    return decided.unionByName(ranked).drop("_h", "_bk", "_c")


def _largest_remainders(strata: str, total_fn):
    return lambda counts: stratum_quotas(counts, strata, total_fn(F.col("_N")))


def split_stratified(df: DataFrame, test: float = 0.2, strata: str = "label", key: str = "row_id",
                     seed: int = 42, col: str = "split") -> DataFrame:
    """SA2: adds ``split`` = 'test' | 'train' with label shares kept."""
    def total(n):
        return F.ceil(F.lit(float(test)) * n).cast("long")
    p = _pick(df, strata, key, seed, _largest_remainders(strata, total))
    return p.withColumn(col, F.when(F.col("_picked"), "test").otherwise("train")).drop("_picked")


def split_random(df: DataFrame, test: float = 0.2, key: str = "row_id", seed: int = 42,
                 col: str = "split") -> DataFrame:
    """SA3: the same rule with a single stratum."""
    x = df.withColumn("_one", F.lit(0))
    return split_stratified(x, test, "_one", key, seed, col).drop("_one")


def downsample_stratified(df: DataFrame, n: int, strata: str = "label", key: str = "row_id",
                          seed: int = 42) -> DataFrame:
    """SA1: a stratified subset of n rows when n < N, else every row (rows with a null stratum too)."""
    def total(big_n):
        return F.least(F.lit(int(n)).cast("long"), big_n.cast("long"))
    return _pick(df, strata, key, seed, _largest_remainders(strata, total)).where("_picked").drop("_picked")


def sample_equal_per_class(df: DataFrame, n: int, strata: str = "label", key: str = "row_id",
                           seed: int = 42) -> DataFrame:
    """SA4: min(N_c, n // n_classes) rows of every class, in hash order; a null label is no class.

    k is one number computed first; with a literal k Spark plans a
    partial window group limit, so each task ships at most k rows per class."""
    labelled = df.where(F.col(strata).isNotNull())
    n_classes = labelled.select(F.count_distinct(strata)).first()[0] or 1
    k = n // n_classes
    rn = F.row_number().over(Window.partitionBy(strata).orderBy(hash_key(seed, key), F.col(key)))
    return labelled.withColumn("_rn", rn).where(F.col("_rn") <= k).drop("_rn")


def sample_top_groups(df: DataFrame, top: int = 5, per_group: int = 3, group: str = "grp",
                      key: str = "row_id", seed: int = 42) -> DataFrame:
    """SA5: ``per_group`` rows of each of the ``top`` most frequent groups
    (ties: group name). The top list has at most ``top`` rows, so it is
    broadcast."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    tops = counts.orderBy(F.col("_n").desc(), F.col(group)).limit(top).select(group)
    picked = df.join(F.broadcast(tops), group, "left_semi")
    rn = F.row_number().over(Window.partitionBy(group).orderBy(hash_key(seed, key), F.col(key)))
    return picked.withColumn("_rn", rn).where(F.col("_rn") <= per_group).drop("_rn")


def shuffle(df: DataFrame, key: str = "row_id", seed: int = 42) -> DataFrame:
    """A seeded full reorder as a distributed range-partitioned sort;
    the sort key is kept as ``shuffle_key``."""
    return df.withColumn("shuffle_key", hash_key(seed, key)).orderBy("shuffle_key", key)
