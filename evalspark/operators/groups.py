"""Per-group fairness analysis (G1-G4). Inputs are prediction rows or the
confusion cells of :func:`evalspark.operators.metrics.confusion_cells`;
after the cells everything runs on a few rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.columns import r6
from evalspark.operators.metrics import _group_cells, class_stats, slice_summary


def group_stats(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """G1: examples, accuracy, macro-F1, correct and errors per group."""
    by = list(by)
    s = slice_summary(class_stats(_group_cells(preds_or_cells, by), [*by, "grp"]), [*by, "grp"])
    n = F.col("support").cast("bigint")
    correct = F.col("n_correct").cast("bigint")
    return s.select(*by, "grp", n.alias("n_examples"), r6("accuracy").alias("accuracy"),
                    r6("f1").alias("f1_macro"), correct.alias("n_correct"), (n - correct).alias("n_errors"))


def group_dispersion(stats: DataFrame, by: Sequence[str] = ("model",), value: str = "f1_macro") -> DataFrame:
    """Mean, population std, min, max, range and CV (%) of group F1."""
    by = list(by)
    x = F.col(value)
    s = stats.groupBy(*by).agg(F.count(x).alias("n_groups"), F.avg(x).alias("mean"),
                               F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return s.select(*by, "n_groups", r6("mean").alias("mean"), r6("std").alias("std"), r6("min").alias("min"),
                    r6("max").alias("max"), r6(F.col("max") - F.col("min")).alias("range"),
                    r6(F.when(F.col("mean") != 0, F.col("std") / F.col("mean") * 100)).alias("cv_pct"))


def groups_vs_mean(stats: DataFrame, by: Sequence[str] = ("model",), value: str = "f1_macro") -> DataFrame:
    """Each group's delta to the mean of its model; 'above' when >= mean.

    The mean comes from a window over the group-level rows (one row per
    group), not from a join."""
    by = list(by)
    mean = F.avg(value).over(Window.partitionBy(*by))
    out = stats.select(*by, "grp", F.col(value).alias("f1"), mean.alias("_mean"))
    return out.select(*by, "grp", "f1", r6(F.col("f1") - F.col("_mean")).alias("delta"),
                      (F.round("f1", 9) >= F.round("_mean", 9)).alias("above_mean"))


def best_worst_groups(stats: DataFrame, k: int = 5, by: Sequence[str] = ("model",),
                      value: str = "f1_macro") -> DataFrame:
    """Top k and bottom k groups by F1 (ties: group name; the bottom list
    is the tail of the descending order, read backwards)."""
    by = list(by)
    v = F.round(value, 9)
    best = F.row_number().over(Window.partitionBy(*by).orderBy(v.desc(), F.col("grp").asc()))
    worst = F.row_number().over(Window.partitionBy(*by).orderBy(v.asc(), F.col("grp").desc()))
    ranked = stats.select("*", best.alias("_b"), worst.alias("_w"))
    sides = F.explode(F.array(F.struct(F.lit("best").alias("side"), F.col("_b").alias("rank")),
                              F.struct(F.lit("worst").alias("side"), F.col("_w").alias("rank"))))
    x = ranked.select("*", sides.alias("_s")).where(F.col("_s.rank") <= k)
    return x.select(F.col("_s.side").alias("side"), F.col("_s.rank").alias("rank"), *by, "grp",
                    F.col(value).alias("f1"), "accuracy", "n_examples", "n_errors")
