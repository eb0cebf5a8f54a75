"""Classification metrics.

Every metric derives from one small intermediate, the confusion cells
``(keys..., actual, predicted, n, sum_prob)``. Building it is the only pass
over the prediction rows: a hash aggregate with map-side partial
aggregation, so a group holding a third of all rows is pre-combined in every
task and the shuffle carries at most keys x labels^2 rows per task. All later
steps touch only these cells.

Semantics follow the public scikit-learn definitions: labels of a slice are
actual U predicted within the slice, division by zero gives 0,
F1 = 2tp / (2tp + fp + fn), balanced accuracy = mean recall over the labels
present in actual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.columns import r6, safe_div

A, P = "actual_label", "predicted_label"


def confusion_cells(preds: DataFrame, by: Sequence[str] = ("model",), group_col: str | None = "grp",
                    prob_col: str = "predicted_probability") -> DataFrame:
    """M1: counts per (by..., scope, group, actual, predicted).

    With a group column, per-group and overall cells come from one
    ``GROUPING SETS`` aggregate (Expand + partial/final aggregate, one
    exchange). ``scope`` is 'group' or 'overall'; the group value is null on
    overall rows (a null group in the data appears with scope 'group').
    """
    keys = list(by)
    prob = F.col(prob_col).cast("double") if prob_col in preds.columns else F.lit(None).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("_p").alias("sum_prob")]
    if group_col is None:
        base = preds.select(*keys, A, P, prob.alias("_p"))
        out = base.groupBy(*keys, A, P).agg(*aggs)
        return out.select(*keys, F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("grp"),
                          A, P, "n", "sum_prob")
    base = preds.select(*keys, F.col(group_col).alias("grp"), A, P, prob.alias("_p"))
    sets = [[*keys, "grp", A, P], [*keys, A, P]]
    out = base.groupingSets(sets, *keys, "grp", A, P).agg(*aggs, F.grouping("grp").alias("_g"))
    scope = F.when(F.col("_g") == 1, "overall").otherwise("group")
    return out.select(*keys, scope.alias("scope"), "grp", A, P, "n", "sum_prob")


def class_stats(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (keys..., label): tp, support, predicted count, precision, recall, f1.

    Each cell contributes (actual: tp, support) and (predicted: count); the
    labels of a slice are therefore actual U predicted.
    """
    keys = list(keys)
    n = F.col("n").cast("bigint")
    zero = F.lit(0).cast("bigint")
    recs = F.array(
        F.struct(F.col(A).alias("label"), F.when(F.col(A) == F.col(P), n).otherwise(zero).alias("tp"),
                 n.alias("support"), zero.alias("pred_n")),
        F.struct(F.col(P).alias("label"), zero.alias("tp"), zero.alias("support"), n.alias("pred_n")))
    ex = cells.select(*keys, F.explode(recs).alias("r")).select(*keys, "r.*")
    st = ex.groupBy(*keys, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                         F.sum("pred_n").alias("pred_n"))
    return st.select(*keys, "label", "tp", "support", "pred_n",
                     safe_div("tp", "pred_n").alias("precision"),
                     safe_div("tp", "support").alias("recall"),
                     safe_div(F.col("tp") * 2, F.col("support") + F.col("pred_n")).alias("f1"))


def slice_summary(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro averages, weighted averages, balanced accuracy and accuracy per slice."""
    keys = list(keys)
    sup = F.col("support")
    return stats.groupBy(*keys).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.avg(F.when(sup > 0, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum(F.col("precision") * sup) / F.sum(sup)).alias("w_precision"),
        (F.sum(F.col("recall") * sup) / F.sum(sup)).alias("w_recall"),
        (F.sum(F.col("f1") * sup) / F.sum(sup)).alias("w_f1"),
        (F.sum("tp") / F.sum(sup)).alias("accuracy"),
        F.sum("tp").alias("n_correct"),
        F.sum(sup).alias("support"))


def _group_cells(preds_or_cells: DataFrame, by: Sequence[str]) -> DataFrame:
    if "scope" in preds_or_cells.columns:
        return preds_or_cells.where((F.col("scope") == "group") & F.col("grp").isNotNull())
    return (preds_or_cells.where(F.col("grp").isNotNull())
            .groupBy(*by, "grp", A, P).agg(F.count(F.lit(1)).alias("n")))


def metrics_by_group(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """M10 (flagship): macro precision/recall/F1, balanced accuracy and support
    per group. Rows with a null group are left out (they count overall)."""
    by = list(by)
    cells = _group_cells(preds_or_cells, by)
    s = slice_summary(class_stats(cells, [*by, "grp"]), [*by, "grp"])
    return s.select(*by, "grp", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"), r6("balanced_accuracy").alias("balanced_accuracy"),
                    F.col("support").cast("bigint").alias("support"))


def _overall_cells(preds_or_cells: DataFrame, by: Sequence[str]) -> DataFrame:
    if "scope" in preds_or_cells.columns:
        return preds_or_cells.where(F.col("scope") == "overall")
    return preds_or_cells.groupBy(*by, A, P).agg(F.count(F.lit(1)).alias("n"))


def class_report(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """M4: precision, recall, F1 and support of every label in actual U predicted."""
    by = list(by)
    st = class_stats(_overall_cells(preds_or_cells, by), by)
    return st.select(*by, F.col("label").cast("string").alias("row_name"),
                     r6("precision").alias("precision"), r6("recall").alias("recall"),
                     r6("f1").alias("f1"), F.col("support").cast("bigint").alias("support"))


def accuracy(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """M5: share of correct predictions."""
    by = list(by)
    c = _overall_cells(preds_or_cells, by)
    n = F.col("n")
    return c.groupBy(*by).agg(
        r6(F.sum(F.when(F.col(A) == F.col(P), n).otherwise(0)) / F.sum(n)).alias("accuracy"),
        F.sum(n).cast("bigint").alias("support"))


def averages(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """M6 + M7 + M8: macro and weighted averages and balanced accuracy."""
    by = list(by)
    s = slice_summary(class_stats(_overall_cells(preds_or_cells, by), by), by)
    return s.select(*by, r6("precision").alias("macro_precision"), r6("recall").alias("macro_recall"),
                    r6("f1").alias("macro_f1"), r6("w_precision").alias("weighted_precision"),
                    r6("w_recall").alias("weighted_recall"), r6("w_f1").alias("weighted_f1"),
                    r6("balanced_accuracy").alias("balanced_accuracy"),
                    F.col("support").cast("bigint").alias("support"))


def full_report(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """M9: class rows, then 'accuracy', 'macro avg', 'weighted avg'.

    The accuracy row carries the accuracy in ``f1`` with the real support
    and null precision/recall.
    """
    by = list(by)
    cells = _overall_cells(preds_or_cells, by)
    st = class_stats(cells, by)
    s = slice_summary(st, by)
    nul = F.lit(None).cast("double")
    sup = F.col("support").cast("bigint")
    # one row per model explodes into the three summary rows (no union of
    # separately planned branches)
    rows = F.array(
        F.struct(F.lit("accuracy").alias("row_name"), nul.alias("precision"), nul.alias("recall"),
                 F.col("accuracy").alias("f1"), sup.alias("support")),
        F.struct(F.lit("macro avg").alias("row_name"), F.col("precision"), F.col("recall"), F.col("f1"),
                 sup.alias("support")),
        F.struct(F.lit("weighted avg").alias("row_name"), F.col("w_precision").alias("precision"),
                 F.col("w_recall").alias("recall"), F.col("w_f1").alias("f1"), sup.alias("support")))
    summ = s.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    cls = st.select(*by, F.col("label").cast("string").alias("row_name"), "precision", "recall", "f1", sup.alias("support"))
    out = cls.unionByName(summ)
    return out.select(*by, "row_name", r6("precision").alias("precision"), r6("recall").alias("recall"),
                      r6("f1").alias("f1"), F.col("support").cast("bigint").alias("support"))


def actual_label_cells(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Overall cells restricted to predictions whose label occurs in actual
    (the confusion matrix is over the actual labels only)."""
    by = list(by)
    c = _overall_cells(preds_or_cells, by).select(*by, A, P, "n")
    labels = c.select(*by, F.col(A).alias("_lab")).distinct()
    return c.join(labels, [*[c[k] == labels[k] for k in by], c[P] == labels["_lab"]], "left_semi")


def confusion_matrix(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """M2 (long form, zero-filled): n per (actual, predicted) over the sorted
    actual labels; predictions of other labels leave the matrix.

    The label x label grid is built per model from the distinct actual
    labels (a handful of rows); it is expanded with ``explode`` of the
    collected label list, bounded by the label count.
    """
    by = list(by)
    cells = actual_label_cells(preds_or_cells, by)
    labs = (_overall_cells(preds_or_cells, by).groupBy(*by)
            .agg(F.array_sort(F.collect_set(A)).alias("_labs")))
    grid = labs.select(*by, F.explode("_labs").alias(A), "_labs").select(*by, A, F.explode("_labs").alias(P))
    out = grid.join(cells, [*by, A, P], "left").select(*by, A, P, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return out


def confusion_matrix_normalized(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """M3: the M2 matrix divided by its row sums (true class)."""
    by = list(by)
    m = confusion_matrix(preds_or_cells, by)
    w = Window.partitionBy(*by, A)
    return m.select(*by, A, P, "n", r6(safe_div(F.col("n"), F.sum("n").over(w))).alias("row_share"))


def confusion_matrix_wide(preds_or_cells: DataFrame, by: Sequence[str] = ("model",),
                          labels: Sequence | None = None) -> DataFrame:
    """M2 as a pivot: one row per actual label, one column per predicted
    label. Passing the labels avoids the extra job that finds them."""
    by = list(by)
    m = confusion_matrix(preds_or_cells, by)
    g = m.groupBy(*by, A)
    g = g.pivot(P, list(labels)) if labels is not None else g.pivot(P)
    return g.agg(F.max("n"))


def f1_per_class(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """One-vs-rest F1 of each label present in actual."""
    by = list(by)
    st = class_stats(_overall_cells(preds_or_cells, by), by).where(F.col("support") > 0)
    return st.select(*by, F.col("label").alias(A), r6("f1").alias("f1"))


def argmax_scores(scores: DataFrame, scores_col: str = "scores") -> DataFrame:
    """Predicted id = numeric suffix of the label with the highest score,
    probability = that score; the first label wins ties."""
    best = F.array_max(F.transform(scores_col, lambda s, i: F.struct(
        s["score"].alias("score"), (-i).alias("neg_pos"), s["label"].alias("label"))))
    out = scores.withColumn("_best", best)
    return out.withColumn(P, F.regexp_extract("_best.label", r"_(\d+)$", 1).cast("int")) \
              .withColumn("predicted_probability", F.col("_best.score")).drop("_best", scores_col)


def eval_metrics(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro precision/recall/F1 and balanced accuracy of the argmax."""
    by = list(by)
    pred = argmax_scores(scores)
    cells = pred.groupBy(*by, A, P).agg(F.count(F.lit(1)).alias("n"))
    s = slice_summary(class_stats(cells, by), by)
    return s.select(*by, r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"), r6("balanced_accuracy").alias("balanced_accuracy"))
