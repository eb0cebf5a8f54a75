"""The four end-to-end flows (train and evaluate, compare, build the
dataset, explain) as compositions of the operators. Each returns lazy
DataFrames (or writes them when a path is given); heavy intermediates are
shared through one small cached or checkpointed table, never through the
driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators import compare as C
from evalspark.operators import errors as E
from evalspark.operators import explain as X
from evalspark.operators import generate as V
from evalspark.operators import groups as G
from evalspark.operators import metrics as M
from evalspark.operators import models as MD
from evalspark.operators import prep as PR
from evalspark.operators import sample as SA
from evalspark.session import reliable_checkpoint
from evalspark.sources import io as IO


def evaluate(predictions: DataFrame, by: Sequence[str] = ("model",), positive=1, top_failures: int = 50,
             out_dir: str | None = None) -> dict[str, DataFrame]:
    """Entry 1 (evaluation part): every report from the confusion cells
    (keys x groups x labels^2 rows), which are checkpointed after one pass
    over the predictions; only the top failures read them again. Without a
    ``grp`` column the reports by group are left out."""
    by = list(by)
    grouped = "grp" in predictions.columns
    cells = reliable_checkpoint(M.confusion_cells(predictions, by, "grp" if grouped else None))
    out = {
        "classification_report": M.full_report(cells, by),
        "confusion_matrix": M.confusion_matrix_normalized(cells, by),
        "error_types": E.error_types(cells, 10, by),
        "errors_by_class": E.errors_by_class(cells, by),
        "error_rate": E.error_rate(cells, by),
        "fn_fp": E.fn_fp_distribution(cells, positive, by),
        "top_failures": E.top_failures(predictions, top_failures, by),
    }
    if grouped:
        gstats = G.group_stats(cells, by)
        out |= {
            "metrics_by_group": M.metrics_by_group(cells, by),
            "group_stats": gstats,
            "group_dispersion": G.group_dispersion(gstats, by),
            "groups_vs_mean": G.groups_vs_mean(gstats, by),
            "best_worst_groups": G.best_worst_groups(gstats, 5, by),
            "errors_by_group": E.error_summary_by_group(cells, by),
        }
    if out_dir:
        for name, df in out.items():
            IO.write_table(df, f"{out_dir.rstrip('/')}/{name}")
    return out


def train_and_evaluate(samples: DataFrame, positive_label: str = "stereotype", test: float = 0.2,
                       seed: int = 42, cfg: MD.LogRegConfig | None = None, model_name: str = "tfidf_logreg",
                       model_path: str | None = None) -> dict[str, DataFrame]:
    """Entry 1: binarise, stratified split, fit TF-IDF + logistic regression
    on the train part, predict the test part, evaluate (and optionally
    persist the fitted pipeline)."""
    x = PR.binarize_label(samples, positive_label)
    s = SA.split_stratified(x, test, "label", "row_id", seed)
    train, tst = s.where("split = 'train'"), s.where("split = 'test'")
    model = MD.fit_logreg(train, "label_int", "text", cfg)
    if model_path:
        MD.save_model(model, model_path)
    keep = ["row_id", "text", "label_int"] + [c for c in ("grp",) if c in samples.columns]
    p = MD.predict(model, tst, keep=keep).withColumnRenamed("label_int", "actual_label")
    p = reliable_checkpoint(p.withColumn("model", F.lit(model_name)))  # scored once
    out = evaluate(p)
    out["predictions"] = p
    return out


def compare(predictions: DataFrame, registry: DataFrame, reps: int = 2000, seed: int = 42,
            key: str = "row_id", report_dir: str | None = None) -> DataFrame:
    """Entry 2: every registered pair in one job (C9); optional text report
    per pair."""
    mode = "text" if key == "text" else "row_id"
    res = C.compare_all(predictions, registry, reps, seed, mode=mode, key=key)
    if report_dir:
        IO.write_text_report(IO.comparison_report_lines(res), report_dir, by=["pair_id"])
    return res


def build_dataset(pairs: DataFrame, generator_factory: Callable[[], Callable[[str], str]],
                  positive_label: str = "stereotype", seed: int = 42, out_dir: str | None = None) -> DataFrame:
    """Entry 3: sentence pairs -> labelled sentences -> prompts -> generator
    -> parsed variants -> union with the originals -> seeded shuffle; written
    once, one folder per label, when ``out_dir`` is given."""
    orig = PR.pairs_to_samples(pairs, positive_label)
    variants = V.to_variants(V.parse_response(V.generate(V.build_prompt(orig), generator_factory)))
    combined = V.combine_variants(orig, variants)
    shuffled = SA.shuffle(combined.withColumn("_k", F.concat_ws(":", "row_id", "origin")), "_k", seed).drop("_k")
    if out_dir:
        IO.write_by_label(shuffled, out_dir)
    return shuffled


def explain(samples: DataFrame, scorer, top_groups: int = 5, per_group: int = 3, num_samples: int = 1000,
            num_features: int = 10, seed: int = 42) -> dict[str, DataFrame]:
    """Entry 4: explain sampled instances of the largest groups, then the
    aggregate word lists and per-instance digests."""
    w = X.explain_by_group(samples, scorer, top_groups, per_group, num_samples, num_features, seed)
    w = reliable_checkpoint(w)
    return {"weights": w, "top_words": X.lime_top_words(w), "digest": X.lime_digest(w)}
