import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions.columns import chi2_1_sf
from evalspark.operators import compare as C

# Published (b, c) -> (chi2, p, stars) of the eight comparisons.
GOLDEN_MCNEMAR = [((182, 64), 55.6463, None, "***"), ((2, 14), 7.5625, 0.005960, "**"),
                  ((40, 32), 0.6806, 0.409395, "ns"), ((36, 36), 0.0139, 0.906186, "ns"),
                  ((22, 29), 0.7059, 0.400814, "ns"), ((9, 6), 0.2667, 0.605577, "ns"),
                  ((115, 40), 35.3290, None, "***"), ((323, 49), 200.3468, None, "***")]


def test_golden_mcnemar(spark):
    df = spark.createDataFrame([(i, b, c) for i, ((b, c), *_rest) in enumerate(GOLDEN_MCNEMAR)],
                               "pair_id int, b long, c long")
    got = {r["pair_id"]: r for r in C.mcnemar(df).collect()}
    for i, ((b, c), chi2, p, stars) in enumerate(GOLDEN_MCNEMAR):
        assert round(got[i]["chi2"], 4) == pytest.approx(chi2, abs=1e-4)
        assert got[i]["stars"] == stars
        if p is not None:
            assert round(got[i]["p_value"], 6) == pytest.approx(p, abs=1e-6)
        else:
            assert got[i]["p_value"] < 0.001


def test_no_discordant(spark):
    df = spark.createDataFrame([(1, 0, 0)], "pair_id int, b long, c long")
    r = C.mcnemar(df).first()
    assert r["chi2"] == 0.0 and r["p_value"] == 1.0 and r["stars"] == "ns"


def test_tail_at_the_critical_value(spark):
    p = spark.range(1).select(chi2_1_sf(F.lit(3.841458820694124))).first()[0]
    assert p == pytest.approx(0.05, abs=1e-12)


def _preds(spark, rows):
    return spark.createDataFrame(rows, "model string, row_id long, text string, actual_label int, predicted_label int")


def test_empty_align_status(spark):
    p = _preds(spark, [("A", 1, "x", 0, 0), ("A", 2, "y", 1, 1), ("B", 3, "z", 0, 1)])
    reg = spark.createDataFrame([(1, "A", "B", "A vs B", "t")], "pair_id int, model_a string, model_b string, name string, category string")
    r = C.compare_all(p, reg, reps=50).first()
    assert r["status"] == "no_common_rows" and r["n_common"] == 0 and r["n_a"] == 2 and r["n_b"] == 1


def _random_pair(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    pa = np.where(rng.random(n) < 0.2, 1 - y, y)
    pb = np.where(rng.random(n) < 0.3, 1 - y, y)
    rows = [("A", i, f"t{i % 500}", int(y[i]), int(pa[i])) for i in range(n)]
    rows += [("B", i, f"t{i % 500}", int(y[i]), int(pb[i])) for i in range(n)]
    return _preds(spark, rows)


def _reg(spark, a="A", b="B"):
    return spark.createDataFrame([(1, a, b, "x", "t")], "pair_id int, model_a string, model_b string, name string, category string")


def test_swap_symmetry(spark):
    p = _random_pair(spark)
    ab = C.compare_all(p, _reg(spark), reps=200).first()
    ba = C.compare_all(p, _reg(spark, "B", "A"), reps=200).first()
    assert ab["chi2"] == ba["chi2"] and ab["b"] == ba["c"]
    assert ab["delta_f1"] == pytest.approx(-ba["delta_f1"], abs=1e-9)


def test_bootstrap_std_multinomial_vs_hash(spark):
    p = _random_pair(spark)
    tagged = C.tag_sides(p, _reg(spark))
    cells = C.paired_cells(tagged)
    m = C.bootstrap_summary(C.bootstrap_delta_f1(cells, 1000, 42)).first()
    h = C.bootstrap_summary(C.bootstrap_delta_f1_hash(C.aligned_rows(tagged), 400, 42)).first()
    assert m["reps"] == 1000 and h["reps"] == 400
    assert abs(m["delta_std"] - h["delta_std"]) / h["delta_std"] < 0.15
    assert abs(m["delta_mean"] - h["delta_mean"]) < 3 * h["delta_std"] / np.sqrt(50)


def test_bootstrap_independent_of_partitioning(spark):
    p = _random_pair(spark)
    cells = C.paired_cells(C.tag_sides(p, _reg(spark)))
    a = sorted(tuple(r) for r in C.bootstrap_delta_f1(cells, 100, 7, partitions=1).collect())
    b = sorted(tuple(r) for r in C.bootstrap_delta_f1(cells, 100, 7, partitions=7).collect())
    assert a == b


def test_text_alignment_fans_out_as_multiplicity(spark):
    p = _preds(spark, [("A", 1, "same", 0, 0), ("A", 2, "same", 0, 1), ("B", 3, "same", 0, 0),
                       ("B", 4, "same", 0, 0), ("B", 5, "same", 0, 1)])
    t = C.tag_two(p.where("model = 'A'"), p.where("model = 'B'"), key="text")
    al = C.aligned_rows(t, "text", "text")
    assert al.agg(F.sum("n")).first()[0] == 6  # 2 x 3 combinations, not materialised
    assert al.count() == 4
    cont = C.paired_contingency(C.paired_cells(t, "text", "text")).first()
    assert cont["n_common"] == 6 and cont["n_a"] == 2 and cont["n_b"] == 3


def test_repeated_row_ids_are_counted(spark):
    p = _preds(spark, [("A", 1, "x", 0, 0), ("A", 1, "x", 0, 1), ("B", 1, "x", 0, 1)])
    cont = C.paired_contingency(C.paired_cells(C.tag_sides(p, _reg(spark)))).first()
    assert (cont["n_common"], cont["both_wrong"], cont["b"], cont["c"]) == (2, 1, 1, 0)
    assert (cont["n_a"], cont["n_b"]) == (2, 1)


def test_bootstrap_independent_of_cell_order(spark):
    cells = [(1, 0, 0, 0, 50), (1, 0, 0, 1, 7), (1, 0, 1, 0, 9), (1, 1, 1, 1, 30), (1, 1, 0, 1, 5)]
    schema = "pair_id long, actual_label int, pred_a int, pred_b int, n long"
    a = C.bootstrap_delta_f1(spark.createDataFrame(cells, schema), 600, 3)
    b = C.bootstrap_delta_f1(spark.createDataFrame(cells[::-1], schema).repartition(5), 600, 3, partitions=2)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() == 600


@pytest.mark.parametrize("key", ["row_id", "text"])
def test_bootstrap_spread_agrees_in_both_key_modes(spark, key):
    p = _random_pair(spark)
    tagged = C.tag_sides(p, _reg(spark), key)
    m = C.bootstrap_summary(C.bootstrap_delta_f1(C.paired_cells(tagged, key, key), 2000, 42)).first()
    h = C.bootstrap_summary(C.bootstrap_delta_f1_hash(C.aligned_rows(tagged, key, key), 1000, 42, key)).first()
    assert abs(m["delta_std"] - h["delta_std"]) / m["delta_std"] < 0.1


def test_alignment_shuffles_once_for_any_number_of_pairs(spark):
    p = _random_pair(spark)
    for n in (3, 30):
        reg = spark.createDataFrame([(i, "A", "B", "x", "t") for i in range(n)],
                                    "pair_id int, model_a string, model_b string, name string, category string")
        plan = C.aligned_rows(C.tag_sides(p, reg))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(row_id") == 1 and "Join" not in plan


def test_chi_square_tail_is_that_of_erfc(spark):
    import math

    x = spark.range(0, 20_001).select((F.col("id") / 20.0).alias("x")).union(spark.range(0, 2000).select(F.col("id") / 211.0))
    rows = x.select("x", chi2_1_sf("x").alias("p")).collect()
    for r in rows:
        want = math.erfc(math.sqrt(r["x"] / 2))
        assert abs(r["p"] - want) < 1e-14 and abs(r["p"] - want) <= 1e-12 * want
    odd = spark.sql("select cast(null as double) as x union all select -1.0D union all select 5000.0D")
    assert [r["p"] for r in odd.select(chi2_1_sf("x").alias("p")).collect()] == [None, 1.0, 0.0]
    plan = x.select(chi2_1_sf("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_text_key_alignment_of_a_repeated_text(spark):
    """Published: 1,006 predictions a side with one text twice align to 1,008 rows."""
    rows = [(m, i, f"t{min(i, 1004)}", i % 2 if i < 1004 else 0, 0) for m in "AB" for i in range(1006)]
    registry = spark.createDataFrame([(1, "A", "B", "A vs B", "x")],
                                     "pair_id int, model_a string, model_b string, name string, category string")
    tagged = C.tag_sides(_preds(spark, rows), registry, "text")
    r = C.paired_contingency(C.paired_cells(tagged, "text", "text")).first()
    assert (r["n_a"], r["n_b"], r["n_common"]) == (1006, 1006, 1008)
    assert (r["both_correct"], r["both_wrong"], r["b"], r["c"]) == (506, 502, 0, 0)


@pytest.mark.parametrize("key", ["row_id", "text"])
def test_bootstrap_hash_weights_each_row_and_unit(spark, key):
    """Weights against hashlib, one string after another; a replicate is not a row of its own before the cells."""
    import hashlib
    reps, kind = 12, "long" if key == "row_id" else "string"
    names = [3, 12345, 10 ** 15, None] if key == "row_id" else ["a", "x" * 50, "é" * 200, None]
    rows = [(p, k, a, pa, pb, n) for p in (1, 2) for i, k in enumerate(names)
            for a, pa, pb, n in ((1, 1, 0, 1 + i), (0, 0, 1, 70), (1, 0, 1, 5000 if i == 2 and p == 1 else 2), (0, 1, 1, 1))]
    aligned = spark.createDataFrame(rows, f"pair_id int, {key} {kind}, actual_label int, pred_a int, pred_b int, n long")
    want = {}
    for p, k, a, pa, pb, n in rows:
        for r in range(reps):
            def weight(*more):
                s = ":".join(str(x) for x in (42, p, r, k, *more) if x is not None)
                u = int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 2 ** 32
                return sum(u >= t for t in C.POISSON1_CDF)
            w = n * weight() if key == "row_id" else sum(weight(pa, pb, u) for u in range(1, n + 1))
            want[p, r, a, pa, pb] = want.get((p, r, a, pa, pb), 0) + w
    cells = spark.createDataFrame([(*c, w) for c, w in want.items()],
                                  "pair_id int, rep int, actual_label int, pred_a int, pred_b int, n long")
    f = C.paired_f1(cells, ["pair_id", "rep"])
    want = {(r["pair_id"], r["rep"]): r["f1_b"] - r["f1_a"] for r in f.collect()}
    got = C.bootstrap_delta_f1_hash(aligned, reps, key=key)
    assert {(r["pair_id"], r["rep"]): r["delta_f1"] for r in got.collect()} == pytest.approx(want, abs=1e-12)
    assert len(want) >= 20
    assert "sequence(0, 11" not in got._jdf.queryExecution().optimizedPlan().toString()
