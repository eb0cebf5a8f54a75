import pytest
from pyspark.sql import functions as F

from evalspark.operators import errors as E
from evalspark.operators import groups as G
from evalspark.operators import stats as S
from tests.conftest import preds_from_cells

# Published per-group F1 of the final model (ten groups).
GOLDEN_F1 = [0.8200466598383976, 0.9038461538461539, 0.8828616352201257, 0.858712715855573, 0.6635997699827487,
             0.8043184885290149, 0.8979591836734694, 0.886021505376344, 0.873015873015873, 0.8391608391608392]


def test_golden_group_dispersion(spark):
    df = spark.createDataFrame([("m", f"g{i}", v) for i, v in enumerate(GOLDEN_F1)], "model string, grp string, f1_macro double")
    d = G.group_dispersion(df).first()
    assert d["n_groups"] == 10
    assert round(d["mean"], 4) == 0.8430
    assert round(d["std"], 4) == 0.0675
    assert round(d["cv_pct"], 2) == 8.00
    assert round(d["range"], 4) == 0.2402
    h = S.histogram(df, "f1_macro", 15, by=["model"]).collect()
    assert len(h) == 15 and sum(r["n"] for r in h) == 10
    assert max(r["bin"] for r in h if r["n"] > 0) == 14  # the maximum falls into the last bin


def test_best_worst(spark):
    df = spark.createDataFrame([("m", f"g{i}", v, 0.5, 10, 5) for i, v in enumerate(GOLDEN_F1)],
                               "model string, grp string, f1_macro double, accuracy double, n_examples long, n_errors long")
    bw = G.best_worst_groups(df, 5).collect()
    best = [r["grp"] for r in sorted((r for r in bw if r["side"] == "best"), key=lambda r: r["rank"])]
    worst = [r["grp"] for r in sorted((r for r in bw if r["side"] == "worst"), key=lambda r: r["rank"])]
    assert best[0] == "g1" and worst[0] == "g4"


def test_no_probability_column(spark):
    p = preds_from_cells(spark, {(0, 1): 3, (1, 1): 2}, grp="g").drop("predicted_probability")
    t = E.top_failures(p, 2).orderBy("rank").collect()
    assert [r["row_id"] for r in t] == [0, 1]
    s = E.error_summary_by_group(p).collect()
    assert s[0]["error_count"] == 3 and "average_probability" not in s[0].asDict()


def test_string_labels_error_bucket(spark):
    df = spark.createDataFrame([("stereotype", "neutral"), ("neutral", "stereotype"), ("unrelated", "neutral"),
                                ("neutral", "neutral")], "actual_label string, predicted_label string")
    b = [r["bucket"] for r in E.error_bucket(df, positive="stereotype").collect()]
    assert b == ["FN", "FP", "other", "correct"]


def test_source_line_dedupe(spark):
    preds = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "text string, row_id long")
    src = spark.createDataFrame([("a", 10), ("a", 5), ("b", 7)], "text string, row_id long")
    r = {x["text"]: x for x in E.attach_source_line(preds, src).collect()}
    assert r["a"]["original_line_number"] == 5 and r["a"]["n_source_matches"] == 2
    assert r["z"]["original_line_number"] is None and r["z"]["n_source_matches"] == 0
    assert len(r) == 3


def test_five_number(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]], "x double")
    f = S.five_number(df, "x").first()
    assert f["median"] == 3.0 and f["q1"] == 2.0 and f["q3"] == 4.0
    assert f["whisker_hi"] == 4.0 and f["n_outliers"] == 1
