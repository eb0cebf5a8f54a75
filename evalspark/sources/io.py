"""Sources and sinks (S1-S8). Readers take explicit schemas (no inference)
and select only the needed columns so the scan reads only those."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.sources.quoted import read_quoted

PAIRS_SCHEMA = "sent_more string, sent_less string, stereo_antistereo string, bias_type string"
PREDICTIONS_SCHEMA = ("row_id long, text string, actual_label int, predicted_label int, "
                      "predicted_probability double, grp string, dataset_name string")


def read_delimited(spark: SparkSession, path: str, schema: str = PAIRS_SCHEMA, sep: str = "\t",
                   header: bool = True, multi_line: bool = True) -> DataFrame:
    """Delimited text with quoted fields that may hold separators,
    doubled quotes and line breaks; large files are read in splits. Without
    ``multi_line`` fields may not hold line breaks, and nothing is read at the call."""
    if multi_line:
        return read_quoted(spark, path, schema, sep, header)
    return (spark.read.schema(schema)
            .option("sep", sep).option("header", header).option("quote", '"').option("escape", '"').csv(path))


def read_samples(spark: SparkSession, path: str, columns: Mapping[str, str] | None = None,
                 fmt: str = "parquet", schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """Read and keep only ``{output: source}`` columns (column pruning
    reaches the scan: ``ReadSchema`` lists only those). CSV: ``multi_line``
    as in S1; without a schema its columns are found by their header, and a file is one task."""
    if fmt == "csv" and schema and multi_line:
        df = read_quoted(spark, path, schema, ",")
        return df.select(*[F.col(src).alias(dst) for dst, src in columns.items()]) if columns else df
    r = spark.read
    if schema:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    df = r.format(fmt).load(path)
    if columns:
        df = df.select(*[F.col(src).alias(dst) for dst, src in columns.items()])
    return df


def read_predictions(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet",
                     schema: str | None = None) -> DataFrame:
    """S3: one result table per model, tagged with the model name and
    unioned by column name (missing columns, e.g. no probability, as null)."""
    out = None
    for model, path in paths.items():
        df = read_samples(spark, path, fmt=fmt, schema=schema).withColumn("model", F.lit(model))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no prediction paths given")
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


def read_available(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet",
                   schema: str | None = None) -> tuple[DataFrame | None, list[str]]:
    """Read the prediction sources that exist (checked through the Hadoop
    file-system API, so any cluster store works); return the union and the
    names of the missing ones."""
    present = {m: p for m, p in paths.items() if path_exists(spark, p)}
    missing = [m for m in paths if m not in present]
    return (read_predictions(spark, present, fmt, schema) if present else None), missing


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> None:
    """Write a table; CSV with a header and quoting that round-trips, blanks at a field's ends included."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = (w.option("header", True).option("quote", '"').option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    w.format(fmt).save(path)


def write_by_label(df: DataFrame, path: str, label: str = "label", fmt: str = "parquet",
                   mode: str = "overwrite") -> None:
    """The whole set, one folder per label value, in a single write."""
    write_table(df, path, fmt, mode, partition_by=[label])


def write_text_report(lines: DataFrame, path: str, by: Sequence[str] = (), line_col: str = "line",
                      order: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """Write report lines as text in ``order`` (section, if there is one, and line_no). With ``by`` one
    folder per value, its lines in order within one file; without, files whose names are in
    the order of their lines."""
    by = list(by)
    order = list(order) if order is not None else [c for c in ("section", "line_no") if c in lines.columns]
    df = lines.repartition(*by).sortWithinPartitions(*by, *order) if by else lines.orderBy(*order)
    w = df.select(*by, line_col).write.mode(mode)
    if by:
        w = w.partitionBy(*by)
    w.text(path)


def comparison_report_lines(compare: DataFrame) -> DataFrame:
    """Report lines of C9 rows: one block per pair (contingency, McNemar,
    bootstrap, verdict)."""
    fmt = [
        ("'Comparison: %s (%s)'", ["name", "category"]),
        ("'Model A: %s  Model B: %s  status: %s'", ["model_a", "model_b", "status"]),
        ("'Rows A: %d  rows B: %d  aligned: %d'", ["n_a", "n_b", "n_common"]),
        ("'Both correct: %d  both wrong: %d  only A correct (b): %d  only B correct (c): %d'",
         ["both_correct", "both_wrong", "b", "c"]),
        (("'McNemar chi2 = %.4f  p = %.6f  %s'", ["chi2", "p_value", "stars"]) if "p_value" in compare.columns
         else ("'McNemar chi2 = %.4f  %s'", ["chi2", "stars"])),
        ("'F1 A = %.4f  F1 B = %.4f  delta (B - A) = %.4f'", ["f1_a", "f1_b", "delta_f1"]),
        ("'Bootstrap mean delta %.4f  std %.4f  95%% CI [%.4f, %.4f]  %s'",
         ["delta_mean", "delta_std", "ci_lower", "ci_upper", "ci_verdict"]),
        ("'Verdict: %s'", ["verdict"]),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("line_no"),
                              F.expr(f"format_string({f}, {', '.join(cols)})").alias("line"))
                     for i, (f, cols) in enumerate(fmt)])
    return compare.select("pair_id", F.explode(rows).alias("r")).select("pair_id", "r.line_no", "r.line")


def comparison_summary_lines(compare: DataFrame) -> DataFrame:
    """Summary of C9 rows by category: pairs, successes and failures (pairs
    without common rows), then one line per pair. Columns category, line_no, line."""
    from pyspark.sql import Window

    ok = F.col("status") == "ok"
    head = compare.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok")).select(
        "category", F.lit(0).cast("long").alias("line_no"),
        F.format_string("%s: %d comparisons, %d done, %d failed", "category", "n", "ok", F.col("n") - F.col("ok")).alias("line"))
    place = F.row_number().over(Window.partitionBy("category").orderBy("pair_id")).cast("long")
    pairs = compare.select("category", place.alias("line_no"), F.format_string(
        "  %s: %s", "name", F.when(ok, F.col("verdict")).otherwise(F.col("status"))).alias("line"))
    return head.unionByName(pairs)


def _numbered(df: DataFrame, section: int, order, line) -> DataFrame:
    """(model, section, line_no, line): the lines of one section of each model's report, numbered from 1."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("model").orderBy(*order))
    return df.select("model", F.lit(section).alias("section"), place.cast("long").alias("line_no"), line.alias("line"))


def confusion_report_lines(cells: DataFrame) -> DataFrame:
    """Report lines of the confusion matrix of each model (M3, E6): counts
    with their share of the true class, then total, correct and errors of
    every class and its confusions."""
    from evalspark.operators.errors import errors_by_class, main_confusions
    from evalspark.operators.metrics import A, P, confusion_matrix_normalized

    a, p = F.col(A).cast("string"), F.col(P).cast("string")
    matrix = _numbered(confusion_matrix_normalized(cells), 1, [A, P], F.format_string(
        "Actual %s, predicted %s: %d (%.2f%%)", a, p, "n", F.col("row_share") * 100))
    classes = _numbered(errors_by_class(cells), 2, [A], F.format_string(
        "Class %s: %d rows, %d correct (%.2f%%), %d errors", a, "total", "correct", F.col("accuracy") * 100, "errors"))
    wrong = _numbered(main_confusions(cells), 3, [F.col("n").desc(), A, P], F.format_string(
        "Class %s taken for %s: %d (%.2f%%)", a, p, "n", F.col("share") * 100))
    return matrix.unionByName(classes).unionByName(wrong)


def variance_report_lines(group_stats: DataFrame, k: int = 5) -> DataFrame:
    """Report lines of the spread of F1 over the groups (G2-G4) from G1 rows."""
    from evalspark.operators.groups import best_worst_groups, group_dispersion, groups_vs_mean

    spread = _numbered(group_dispersion(group_stats), 1, ["model"], F.format_string(
        "%d groups: mean F1 %.4f, std %.4f, min %.4f, max %.4f, range %.4f, CV %.2f%%",
        "n_groups", "mean", "std", "min", "max", "range", "cv_pct"))
    each = _numbered(groups_vs_mean(group_stats), 2, [F.col("delta").desc(), "grp"], F.format_string(
        "%s: F1 %.4f, %+.4f to the mean (%s)", "grp", "f1", "delta",
        F.when(F.col("above_mean"), "above").otherwise("below")))
    ends = _numbered(best_worst_groups(group_stats, k), 3, ["side", "rank"], F.format_string(
        "%s %d: %s, F1 %.4f, accuracy %.4f, %d rows, %d errors",
        "side", "rank", "grp", "f1", "accuracy", "n_examples", "n_errors"))
    return spread.unionByName(each).unionByName(ends)


def failure_report_lines(preds: DataFrame, n: int = 20) -> DataFrame:
    """Report lines of the most confident errors of each model."""
    from evalspark.operators.errors import failure_digest
    from evalspark.operators.metrics import A, P

    return _numbered(failure_digest(preds, n), 1, ["case_no"], F.format_string(
        "%d. [%s] actual %s, predicted %s, confidence %s: %s", "case_no", F.coalesce("grp", F.lit("-")),
        F.col(A).cast("string"), F.col(P).cast("string"),
        F.coalesce(F.format_string("%.4f", "confidence"), F.lit("-")), "snippet"))
