"""Golden aggregates from the published reports and metric properties."""

import pytest
from pyspark.sql import functions as F

from evalspark.operators import metrics as M
from tests.conftest import preds_from_cells


def rows(df, key="row_name"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_golden_final_report(spark):
    p = preds_from_cells(spark, {(0, 0): 603, (0, 1): 68, (1, 0): 86, (1, 1): 249})
    rep = rows(M.full_report(p))
    assert rep["accuracy"]["f1"] == pytest.approx(0.8469184890656064, abs=1e-6)
    assert rep["accuracy"]["support"] == 1006 and rep["accuracy"]["precision"] is None
    assert rep["macro avg"]["f1"] == pytest.approx(0.825284193431974, abs=1e-6)
    assert rep["0"]["precision"] == pytest.approx(0.8751814, abs=1e-6)
    assert rep["0"]["recall"] == pytest.approx(0.8986587, abs=1e-6)
    assert rep["0"]["f1"] == pytest.approx(0.8867647, abs=1e-6)
    assert rep["1"]["precision"] == pytest.approx(0.7854890, abs=1e-6)
    assert rep["1"]["recall"] == pytest.approx(0.7432836, abs=1e-6)
    assert rep["1"]["f1"] == pytest.approx(0.7638037, abs=1e-6)
    assert rep["0"]["support"] == 671 and rep["1"]["support"] == 335
    # weighted recall equals accuracy
    assert rep["weighted avg"]["recall"] == pytest.approx(rep["accuracy"]["f1"], abs=1e-6)


def test_golden_majority(spark):
    p = preds_from_cells(spark, {(0, 0): 671, (1, 0): 335})
    a = M.averages(p).first()
    assert a["macro_f1"] == pytest.approx(0.40011926, abs=1e-6)
    assert a["balanced_accuracy"] == pytest.approx(0.5, abs=1e-9)
    assert M.accuracy(p).first()["accuracy"] == pytest.approx(0.66699801, abs=1e-6)


def test_one_class_group_balanced_vs_macro_recall(spark):
    # one actual class, one foreign prediction: labels {0, 1}, class 1 never actual
    p = preds_from_cells(spark, {(0, 0): 4, (0, 1): 1}, grp="g")
    g = M.metrics_by_group(p).first()
    assert g["balanced_accuracy"] == pytest.approx(0.8)
    assert g["recall"] == pytest.approx(0.4)  # macro recall over {0, 1}: (0.8 + 0) / 2
    assert g["precision"] == pytest.approx(0.5)  # zero division for class 1 -> 0
    assert g["support"] == 5


def test_null_group_left_out_per_group_counted_overall(spark):
    a = preds_from_cells(spark, {(0, 0): 3, (1, 1): 2}, grp="g")
    b = preds_from_cells(spark, {(0, 1): 2}, grp=None).withColumn("row_id", F.col("row_id") + 100)
    p = a.unionByName(b)
    g = M.metrics_by_group(p).collect()
    assert [r["grp"] for r in g] == ["g"] and g[0]["support"] == 5
    assert M.accuracy(p).first()["support"] == 7
    cells = M.confusion_cells(p)
    assert cells.where("scope = 'overall'").agg(F.sum("n")).first()[0] == 7
    assert M.metrics_by_group(cells).first()["f1"] == g[0]["f1"]


def test_cells_sum_to_rows(spark):
    p = preds_from_cells(spark, {(0, 0): 5, (0, 2): 3, (2, 1): 4, (1, 1): 1}, grp="x")
    c = M.confusion_cells(p)
    assert c.where("scope = 'overall'").agg(F.sum("n")).first()[0] == 13
    assert c.where("scope = 'group'").agg(F.sum("n")).first()[0] == 13


def test_confusion_matrix_actual_labels_only(spark):
    # predicted label 2 is never actual: it leaves the matrix
    p = preds_from_cells(spark, {(0, 0): 2, (0, 2): 1, (1, 1): 3})
    m = {(r["actual_label"], r["predicted_label"]): r["n"] for r in M.confusion_matrix(p).collect()}
    assert m == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 3}
    f1 = {r["actual_label"]: r["f1"] for r in M.f1_per_class(p).collect()}
    assert set(f1) == {0, 1}


def test_tied_scores_first_label_wins(spark):
    df = spark.createDataFrame([(1, 0, [("LABEL_0", 0.5), ("LABEL_1", 0.5)]),
                                (2, 1, [("LABEL_0", 0.2), ("LABEL_1", 0.8)])],
                               "row_id long, actual_label int, scores array<struct<label:string,score:double>>")
    r = {x["row_id"]: x for x in M.argmax_scores(df).collect()}
    assert r[1]["predicted_label"] == 0 and r[1]["predicted_probability"] == 0.5
    assert r[2]["predicted_label"] == 1


def test_grouping_sets_single_exchange(spark):
    from tests.conftest import SF001
    from evalspark.sources.fixtures import Fixtures
    plan = M.confusion_cells(Fixtures(spark, SF001).predictions)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan


def _np_macro(y, p):
    import numpy as np
    labels = np.union1d(y, p)
    prec, rec, f1, present_rec = [], [], [], []
    for c in labels:
        tp = np.sum((y == c) & (p == c))
        sup, prd = np.sum(y == c), np.sum(p == c)
        prec.append(tp / prd if prd else 0.0)
        rec.append(tp / sup if sup else 0.0)
        f1.append(2 * tp / (sup + prd) if sup + prd else 0.0)
        if sup:
            present_rec.append(tp / sup)
    return np.mean(prec), np.mean(rec), np.mean(f1), np.mean(present_rec)


def test_hot_group_matches_independent_computation(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    n = 3000
    grp = np.where(np.arange(n) < n // 3, "hot", np.array([f"g{i % 7}" for i in range(n)]))
    y = rng.integers(0, 3, n)
    p = np.where(rng.random(n) < 0.3, rng.integers(0, 3, n), y)
    rows = [("m", i, "t", int(y[i]), int(p[i]), 0.5, str(grp[i]), "d") for i in range(n)]
    df = spark.createDataFrame(rows, "model string, row_id long, text string, actual_label int, predicted_label int, "
                                     "predicted_probability double, grp string, dataset_name string")
    got = {r["grp"]: r for r in M.metrics_by_group(df.repartition(7)).collect()}
    for g in np.unique(grp):
        m = grp == g
        pr, rc, f1, bal = _np_macro(y[m], p[m])
        assert got[g]["precision"] == pytest.approx(pr, abs=1e-6)
        assert got[g]["recall"] == pytest.approx(rc, abs=1e-6)
        assert got[g]["f1"] == pytest.approx(f1, abs=1e-6)
        assert got[g]["balanced_accuracy"] == pytest.approx(bal, abs=1e-6)
        assert got[g]["support"] == int(m.sum())
