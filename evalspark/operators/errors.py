"""Error extraction and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.columns import r6, safe_div, snippet
from evalspark.operators.metrics import A, P, actual_label_cells

PROB = "predicted_probability"


def errors(preds: DataFrame) -> DataFrame:
    """P10: rows whose prediction differs from the truth (pushed into the scan
    where the columns come straight from parquet)."""
    return preds.where(F.col(A) != F.col(P))


def error_bucket(preds: DataFrame, positive=1) -> DataFrame:
    """P11: 'FN' (actual positive, predicted other), 'FP' (the reverse), else
    'other' for the remaining errors and 'correct' for correct rows. Works
    for int or string labels."""
    a, p, pos = F.col(A), F.col(P), F.lit(positive)
    b = (F.when(a == p, "correct").when(a == pos, "FN").when(p == pos, "FP").otherwise("other"))
    return preds.withColumn("bucket", b)


def attach_source_line(preds: DataFrame, source: DataFrame, key: str = "text",
                       line_col: str = "row_id", out_col: str = "original_line_number") -> DataFrame:
    """Left join on the text to fetch the source line number.

    Duplicate texts in the source are collapsed first to (first line, number
    of matches): every prediction row survives exactly once and the
    multiplicity is kept as a column instead of fanning rows out, so a text
    repeated in a third of the source cannot multiply the output. The
    one-row-per-key side is pre-aggregated map-side; AQE splits skewed
    partitions of the prediction side.
    """
    src = source.groupBy(F.col(key).alias("_k")).agg(F.min(line_col).alias(out_col),
                                                     F.count(F.lit(1)).alias("n_source_matches"))
    j = preds.join(src, preds[key] == src["_k"], "left").drop("_k")
    return j.withColumn("n_source_matches", F.coalesce("n_source_matches", F.lit(0)).cast("bigint"))


def _cells(preds_or_cells: DataFrame, by: Sequence[str], scope: str) -> DataFrame:
    """Counted rows: (by..., [grp,] actual, predicted, n, sum_prob) from cells of M1 (of one scope) or from predictions."""
    keys = [*by, "grp"] if scope == "group" else list(by)
    if "scope" in preds_or_cells.columns:
        return preds_or_cells.where(F.col("scope") == scope)
    prob = F.sum(PROB) if PROB in preds_or_cells.columns else F.lit(None).cast("double")
    return preds_or_cells.groupBy(*keys, A, P).agg(F.count(F.lit(1)).alias("n"), prob.alias("sum_prob"))


def error_rate(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Errors, total, percent."""
    c = _cells(preds_or_cells, by, "overall")
    s = c.groupBy(*by).agg(F.sum(F.when(F.col(A) != F.col(P), F.col("n")).otherwise(0)).alias("n_errors"),
                           F.sum("n").alias("n_total"))
    return s.select(*by, "n_errors", "n_total", r6(F.col("n_errors") * 100.0 / F.col("n_total")).alias("error_pct"))


def error_table(preds: DataFrame, source: DataFrame) -> DataFrame:
    """Errors with the source line first, globally sorted by line
    (a range-partitioned distributed sort)."""
    e = attach_source_line(errors(preds), source)
    first = ["original_line_number", "n_source_matches"]
    return e.select(*first, *[c for c in e.columns if c not in first]) \
            .orderBy(F.col("original_line_number").asc_nulls_last(), *[c for c in ("model", "row_id") if c in e.columns])


def error_count_by_group(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Error count per group (null groups left out)."""
    e = _cells(preds_or_cells, by, "group").where((F.col(A) != F.col(P)) & F.col("grp").isNotNull())
    return e.groupBy(*by, "grp").agg(F.sum("n").alias("error_count"))


def error_summary_by_group(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Error count and mean predicted probability per group; without a
    probability column only the count. The mean takes no null probabilities
    where predictions are given, and all errors where cells are."""
    if "scope" in preds_or_cells.columns:
        e = preds_or_cells.where((F.col("scope") == "group") & (F.col(A) != F.col(P)) & F.col("grp").isNotNull())
        return e.groupBy(*by, "grp").agg(F.sum("n").alias("error_count"),
                                         r6(F.sum("sum_prob") / F.sum("n")).alias("average_probability"))
    e = errors(preds_or_cells).where(F.col("grp").isNotNull())
    aggs = [F.count(F.lit(1)).alias("error_count")]
    if PROB in preds_or_cells.columns:
        aggs.append(r6(F.avg(PROB)).alias("average_probability"))
    return e.groupBy(*by, "grp").agg(*aggs)


def error_types(preds_or_cells: DataFrame, top: int = 10, by: Sequence[str] = ("model",)) -> DataFrame:
    """E5: count and share of errors per (actual -> predicted), top ``top`` per
    model (ties: actual, predicted). Planned as a window group limit."""
    by = list(by)
    if "n" in preds_or_cells.columns:
        c = preds_or_cells.where(F.col("scope") == "overall") if "scope" in preds_or_cells.columns else preds_or_cells
        c = c.where(F.col(A) != F.col(P)).select(*by, A, P, "n")
    else:
        c = errors(preds_or_cells).groupBy(*by, A, P).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.col("n").desc(), F.col(A), F.col(P)))
    out = c.select(*by, A, P, F.col("n").cast("bigint").alias("n"),
                   r6(F.col("n") * 100.0 / F.sum("n").over(w)).alias("pct_of_errors"), rank.alias("rank"))
    return out.where(F.col("rank") <= top)


def errors_by_class(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Per true class over the actual-label matrix: total, correct, errors."""
    by = list(by)
    c = actual_label_cells(preds_or_cells, by)
    s = c.groupBy(*by, A).agg(F.sum("n").cast("bigint").alias("total"),
                              F.sum(F.when(F.col(A) == F.col(P), F.col("n")).otherwise(0)).cast("bigint").alias("correct"))
    return s.select(*by, A, "total", "correct", (F.col("total") - F.col("correct")).alias("errors"),
                    r6(safe_div("correct", "total")).alias("accuracy"))


def main_confusions(preds_or_cells: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """E6 (second part): each non-empty confusion of a true class with its
    share of that class."""
    by = list(by)
    c = actual_label_cells(preds_or_cells, by)
    w = Window.partitionBy(*by, A)
    out = c.select(*by, A, P, F.col("n").cast("bigint").alias("n"), F.sum("n").over(w).alias("_t"))
    return out.where((F.col(A) != F.col(P)) & (F.col("n") > 0)) \
              .select(*by, A, P, "n", r6(F.col("n") / F.col("_t")).alias("share"))


def fn_fp_distribution(preds_or_cells: DataFrame, positive=1, by: Sequence[str] = ("model",)) -> DataFrame:
    """FN / FP / other counts and their share of the errors."""
    by = list(by)
    b = error_bucket(errors(_cells(preds_or_cells, by, "overall")), positive)
    c = b.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    return c.select(*by, "bucket", "n", r6(F.col("n") * 100.0 / F.sum("n").over(w)).alias("pct_of_errors"))


def top_failures(preds: DataFrame, n: int = 50, by: Sequence[str] = ("model",)) -> DataFrame:
    """Most confident errors first (ties: row_id); without a probability
    column, in row_id order. A per-model window group limit: each task keeps
    only its local top n before the shuffle."""
    by = list(by)
    e = errors(preds)
    order = [F.col(PROB).desc_nulls_last(), F.col("row_id")] if PROB in preds.columns else [F.col("row_id")]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return e.select("*", rank.alias("rank")).where(F.col("rank") <= n)


def failure_digest(preds: DataFrame, n: int = 20, chars: int = 200, by: Sequence[str] = ("model",)) -> DataFrame:
    """Numbered top-n cases with text snippet, labels, confidence, group."""
    t = top_failures(preds, n, by)
    conf = r6(PROB) if PROB in preds.columns else F.lit(None).cast("double")
    return t.select(*by, F.col("rank").alias("case_no"), snippet("text", chars).alias("snippet"),
                    A, P, conf.alias("confidence"), "grp")
