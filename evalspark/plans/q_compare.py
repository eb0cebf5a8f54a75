"""Registered queries: alignment and paired comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.columns import CHI2_1_CRIT_001, CHI2_1_CRIT_01, CHI2_1_CRIT_05, r6
from evalspark.operators import compare as C
from evalspark.plans.oracle import U, sql
from evalspark.plans.q_metrics import class_stats_sql, summary_sql
from evalspark.plans.registry import register
from evalspark.sources.fixtures import Fixtures

REPS_SQL = 2000


def paired_f1_sql(cells: str, keys: list[str], prefix: str = "p") -> list[tuple[str, str]]:
    """DuckDB: macro-F1 of side a and side b per key from paired cells; CTE
    names start with ``prefix`` (the last one is ``{prefix}f1``)."""
    kc = "".join(f"{k}, " for k in keys)
    ks = keys + ["side"]
    return [
        (f"{prefix}long", f"""select {kc}actual_label, n, 'a' as side, pred_a as predicted_label from {cells}
                      where pred_a is not null and pred_b is not null and n > 0
                      union all
                      select {kc}actual_label, n, 'b' as side, pred_b as predicted_label from {cells}
                      where pred_a is not null and pred_b is not null and n > 0"""),
        (f"{prefix}st", class_stats_sql(f"{prefix}long", ks)), (f"{prefix}sum", summary_sql(f"{prefix}st", ks)),
        (f"{prefix}f1", f"""select {kc}max(case when side = 'a' then f1 end) as f1_a,
                               max(case when side = 'b' then f1 end) as f1_b
                        from {prefix}sum group by {', '.join(keys)}"""),
    ]


ALIGNED = ("al", """
select r.pair_id, a.row_id, a.actual_label, a.predicted_label as pred_a, b.predicted_label as pred_b, cast(1 as bigint) as n
from fx_registry r join fx_predictions a on a.model = r.model_a
join fx_predictions b on b.model = r.model_b and b.row_id = a.row_id and b.actual_label = a.actual_label""")

def _wsum(cond: str) -> str:
    return f"cast(coalesce(sum(case when {cond} then al.n end), 0) as bigint)"


# Aligned rows carry a multiplicity n (1 per row id, A x B combinations per text).
CONT = ("cont", f"""
select r.pair_id,
       (select count(*) from fx_predictions p where p.model = r.model_a) as n_a,
       (select count(*) from fx_predictions p where p.model = r.model_b) as n_b,
       cast(coalesce(sum(al.n), 0) as bigint) as n_common,
       {_wsum("pred_a = al.actual_label and pred_b = al.actual_label")} as both_correct,
       {_wsum("pred_a <> al.actual_label and pred_b <> al.actual_label")} as both_wrong,
       {_wsum("pred_a = al.actual_label and pred_b <> al.actual_label")} as b,
       {_wsum("pred_a <> al.actual_label and pred_b = al.actual_label")} as c
from fx_registry r left join al on al.pair_id = r.pair_id group by r.pair_id, r.model_a, r.model_b""")

MCN = ("mc", f"""
select *, case when b + c > 0 then power(abs(b - c) - 1, 2) / (b + c) else 0.0 end as chi2 from cont""")

STARS = (f"case when chi2 > {CHI2_1_CRIT_001} then '***' when chi2 > {CHI2_1_CRIT_01} then '**' "
         f"when chi2 > {CHI2_1_CRIT_05} then '*' else 'ns' end")

_W = " + ".join(f"(case when u >= {t} then 1 else 0 end)" for t in C.POISSON1_CDF)
BOOT = [("bx", f"""
select al.*, cast(r.rep as integer) as rep,
       {U("concat_ws(':', '42', cast(al.pair_id as varchar), cast(r.rep as varchar), cast(al.row_id as varchar))")} as u
from al cross join range(0, {REPS_SQL}) r(rep)"""),
        ("bcells", f"""select pair_id, rep, actual_label, pred_a, pred_b, sum(n * ({_W})) as n from bx group by all""")]
BOOT += paired_f1_sql("bcells", ["pair_id", "rep"])
BOOT += [("deltas", "select pair_id, rep, f1_b - f1_a as delta_f1 from pf1")]

SUMM = ("bs", """
select pair_id, count(delta_f1) as reps, round(avg(delta_f1), 6) as delta_mean, round(stddev_pop(delta_f1), 6) as delta_std,
       round(quantile_cont(delta_f1, 0.025), 6) as ci_lower, round(quantile_cont(delta_f1, 0.975), 6) as ci_upper,
       case when quantile_cont(delta_f1, 0.025) > 0 then 'B better' when quantile_cont(delta_f1, 0.975) < 0 then 'A better'
            else 'no significant difference' end as ci_verdict
from deltas group by pair_id""")


def _fx(spark, sf):
    return Fixtures(spark, sf)


@register("J2_align_row_id", sql(["fx_predictions"], final="""
select 1 as pair_id, a.row_id, a.actual_label, a.predicted_label as pred_a, b.predicted_label as pred_b, cast(1 as bigint) as n
from fx_predictions a join fx_predictions b on a.row_id = b.row_id and a.actual_label = b.actual_label
where a.model = 'A' and b.model = 'B'"""))
def q_j2(spark, sf):
    p = _fx(spark, sf).predictions
    return C.aligned_rows(C.tag_two(p.where("model = 'A'"), p.where("model = 'B'")))


@register("J2_align_text", sql(["fx_predictions"], ("a", """
select text, actual_label, predicted_label as p, count(*) as c from fx_predictions where model = 'A' group by all"""), ("b", """
select text, actual_label, predicted_label as p, count(*) as c from fx_predictions where model = 'B' group by all"""), final="""
select 1 as pair_id, a.text, a.actual_label, a.p as pred_a, b.p as pred_b, cast(a.c * b.c as bigint) as n
from a join b on a.text = b.text and a.actual_label = b.actual_label"""))
def q_j2t(spark, sf):
    p = _fx(spark, sf).predictions
    return C.aligned_rows(C.tag_two(p.where("model = 'A'"), p.where("model = 'B'"), key="text"), "text", "text")


_REPEATED = """
select model, row_id // 3 as row_id, actual_label, predicted_label, count(*) as c from fx_predictions group by all"""


@register("J3_align_duplicate_ids", sql(["fx_predictions", "fx_registry"], ("d", _REPEATED), final="""
select r.pair_id, a.row_id, a.actual_label, a.predicted_label as pred_a, b.predicted_label as pred_b, cast(a.c * b.c as bigint) as n
from fx_registry r join d a on a.model = r.model_a
join d b on b.model = r.model_b and b.row_id = a.row_id and b.actual_label = a.actual_label"""))
def q_j3d(spark, sf):
    """Row ids that repeat: every combination of equal predictions is counted."""
    fx = _fx(spark, sf)
    repeated = fx.predictions.withColumn("row_id", F.floor(F.col("row_id") / 3))
    return C.aligned_rows(C.tag_sides(repeated, fx.registry))


ALIGNED_TEXT = ("al", """
select r.pair_id, a.text, a.actual_label, a.p as pred_a, b.p as pred_b, a.c * b.c as n
from fx_registry r
join (select model, text, actual_label, predicted_label as p, count(*) as c from fx_predictions group by all) a on a.model = r.model_a
join (select model, text, actual_label, predicted_label as p, count(*) as c from fx_predictions group by all) b
  on b.model = r.model_b and b.text = a.text and b.actual_label = a.actual_label""")
BOOT_TEXT = [("units", "select al.*, unnest(range(1, n + 1)) as unit from al"), ("bx", f"""
select units.*, cast(r.rep as integer) as rep,
       {U("concat_ws(':', '42', cast(pair_id as varchar), cast(r.rep as varchar), text, cast(pred_a as varchar), cast(pred_b as varchar), cast(unit as varchar))")} as u
from units cross join range(0, 200) r(rep)"""),
             ("bcells", f"select pair_id, rep, actual_label, pred_a, pred_b, sum({_W}) as n from bx group by all"),
             *paired_f1_sql("bcells", ["pair_id", "rep"]),
             ("deltas", "select pair_id, rep, f1_b - f1_a as delta_f1 from pf1")]


@register("C7_bootstrap_summary_text_key", sql(["fx_predictions", "fx_registry"], ALIGNED_TEXT, *BOOT_TEXT, SUMM,
                                               final="select * from bs"))
def q_c7t(spark, sf):
    fx = _fx(spark, sf)
    aligned = C.aligned_rows(C.tag_sides(fx.predictions, fx.registry, "text"), "text", "text")
    return C.bootstrap_summary(C.bootstrap_delta_f1_hash(aligned, 200, key="text"))


@register("J3_align_all", sql(["fx_predictions", "fx_registry"], ALIGNED, final="select * from al"))
def q_j3(spark, sf):
    fx = _fx(spark, sf)
    return C.aligned_rows(C.tag_sides(fx.predictions, fx.registry))


def _cells(spark, sf, mode="row_id"):
    fx = _fx(spark, sf)
    key = "text" if mode == "text" else "row_id"
    return C.paired_cells(C.tag_sides(fx.predictions, fx.registry, key), key, mode)


@register("C3_paired_contingency", sql(["fx_predictions", "fx_registry"], ALIGNED, CONT, final="select * from cont"))
def q_c3(spark, sf):
    return C.paired_contingency(_cells(spark, sf))


@register("C4_C5_mcnemar", sql(["fx_predictions", "fx_registry"], ALIGNED, CONT, MCN, final=f"""
select pair_id, b, c, round(chi2, 6) as chi2, {STARS} as stars from mc"""))
def q_c4(spark, sf):
    m = C.mcnemar(C.paired_contingency(_cells(spark, sf)), with_p=False)
    return m.select("pair_id", "b", "c", r6("chi2").alias("chi2"), "stars")


def _p_sql(x: str) -> str:
    """erfc(sqrt(x / 2)) by the series below 8 and the continued fraction from 8 on, written out."""
    series = fraction = "1.0::double"
    for k in range(45, 0, -1):
        series = f"(1.0 + {x} / {2 * k + 1} * {series})"
    for k in range(60, 0, -1):
        fraction = f"(1.0 + {k} / {x} / {fraction})"
    return (f"case when {x} < 8 then 1.0 - sqrt(2.0 * {x} / pi()) * exp(-{x} / 2.0) * {series} "
            f"else exp(-{x} / 2.0) / sqrt(pi() * {x} / 2.0) / {fraction} end")


@register("C4_mcnemar_p_value", sql(["fx_predictions", "fx_registry"], ALIGNED, CONT, MCN, final=f"""
select pair_id, b, c, case when b + c > 0 then round({_p_sql("chi2")}, 6) else 1.0 end as p_value,
       case when b + c > 0 and chi2 < 1000 then round(ln({_p_sql("chi2")}), 6) end as ln_p from mc"""))
def q_c4_p(spark, sf):
    """The p-value, and its logarithm, since the p-values of unlike models are zero to any number of places."""
    m = C.mcnemar(C.paired_contingency(_cells(spark, sf)))
    told = (F.col("b") + F.col("c") > 0) & (F.col("chi2") < 1000)
    return m.select("pair_id", "b", "c", r6("p_value").alias("p_value"), F.when(told, r6(F.log("p_value"))).alias("ln_p"))


@register("C6h_bootstrap_hash", sql(["fx_predictions", "fx_registry"], ALIGNED, *BOOT, final="""
select pair_id, rep, round(delta_f1, 6) as delta_f1 from deltas"""))
def q_c6h(spark, sf):
    fx = _fx(spark, sf)
    d = C.bootstrap_delta_f1_hash(C.aligned_rows(C.tag_sides(fx.predictions, fx.registry)), REPS_SQL)
    return d.select("pair_id", "rep", r6("delta_f1").alias("delta_f1"))


def _hash_deltas(spark, sf):
    fx = _fx(spark, sf)
    return C.bootstrap_delta_f1_hash(C.aligned_rows(C.tag_sides(fx.predictions, fx.registry)), REPS_SQL)


@register("C7_bootstrap_summary", sql(["fx_predictions", "fx_registry"], ALIGNED, *BOOT, SUMM, final="select * from bs"))
def q_c7(spark, sf):
    return C.bootstrap_summary(_hash_deltas(spark, sf))


@register("C10_bootstrap_histogram", sql(["fx_predictions", "fx_registry"], ALIGNED, *BOOT, SUMM, ("rg", """
select pair_id, case when max(delta_f1) = min(delta_f1) then min(delta_f1) - 0.5 else min(delta_f1) end as lo,
       case when max(delta_f1) = min(delta_f1) then max(delta_f1) + 0.5 else max(delta_f1) end as hi
from deltas group by pair_id"""), ("hc", """
select d.pair_id, cast(least(floor((delta_f1 - lo) * (50.0 / (hi - lo))), 49) as integer) as bin, count(*) as n
from deltas d join rg on d.pair_id = rg.pair_id group by all"""), final="""
select rg.pair_id, k.bin, round(lo + k.bin * (hi - lo) / 50, 6) as bin_lo, round(lo + (k.bin + 1) * (hi - lo) / 50, 6) as bin_hi,
       cast(coalesce(hc.n, 0) as bigint) as n, bs.delta_mean, bs.ci_lower, bs.ci_upper,
       bs.ci_lower <= 0 and bs.ci_upper >= 0 as zero_inside
from rg cross join (select cast(range as integer) as bin from range(0, 50)) k
left join hc on hc.pair_id = rg.pair_id and hc.bin = k.bin
join bs on bs.pair_id = rg.pair_id"""))
def q_c10(spark, sf):
    return C.bootstrap_histogram(_hash_deltas(spark, sf), 50)


def _c9_sql(mode: str) -> str:
    aligned = ALIGNED if mode == "row_id" else ("al", """
select r.pair_id, a.text as row_id, a.actual_label, a.p as pred_a, b.p as pred_b, a.c * b.c as n
from fx_registry r
join (select model, text, actual_label, predicted_label as p, count(*) as c from fx_predictions group by all) a on a.model = r.model_a
join (select model, text, actual_label, predicted_label as p, count(*) as c from fx_predictions group by all) b
  on b.model = r.model_b and b.text = a.text and b.actual_label = a.actual_label""")
    extra = []
    if mode == "row_id":
        extra = [*BOOT, SUMM]
    return sql(["fx_predictions", "fx_registry"], aligned, CONT, MCN,
               *paired_f1_sql("al", ["pair_id"], prefix="f"), *extra, final=f"""
select r.pair_id, r.model_a, r.model_b, r.name, r.category,
       case when coalesce(mc.n_common, 0) = 0 then 'no_common_rows' else 'ok' end as status,
       cast(mc.n_a as bigint) as n_a, cast(mc.n_b as bigint) as n_b, cast(mc.n_common as bigint) as n_common,
       cast(mc.both_correct as bigint) as both_correct, cast(mc.both_wrong as bigint) as both_wrong,
       cast(mc.b as bigint) as b, cast(mc.c as bigint) as c, round(mc.chi2, 6) as chi2, {STARS} as stars,
       round(f.f1_a, 6) as f1_a, round(f.f1_b, 6) as f1_b, round(f.f1_b - f.f1_a, 6) as delta_f1
       {", bs.delta_mean, bs.delta_std, bs.ci_lower, bs.ci_upper, bs.ci_verdict," if mode == "row_id" else ""}
       {f'''case when mc.chi2 > {CHI2_1_CRIT_05} and bs.ci_lower > 0 then 'B significantly better'
            when mc.chi2 > {CHI2_1_CRIT_05} and bs.ci_upper < 0 then 'A significantly better'
            else 'no significant difference' end as verdict''' if mode == "row_id" else ""}
from fx_registry r left join mc on mc.pair_id = r.pair_id left join ff1 f on f.pair_id = r.pair_id
{"left join bs on bs.pair_id = r.pair_id" if mode == "row_id" else ""}""")


@register("C9_compare_all", _c9_sql("row_id"))
def q_c9(spark, sf):
    fx = _fx(spark, sf)
    return C.compare_all(fx.predictions, fx.registry, reps=REPS_SQL, method="hash", with_p=False)


@register("C9_compare_all_text_key", _c9_sql("text"))
def q_c9t(spark, sf):
    """Contingency, chi2 and observed F1 when rows are matched by text (the
    reference's key): duplicates count as A x B combinations."""
    fx = _fx(spark, sf)
    tagged = C.tag_sides(fx.predictions, fx.registry, "text")
    cells = C.paired_cells(tagged, "text", "text")
    cont = C.mcnemar(C.paired_contingency(cells), with_p=False)
    f1 = C.paired_f1(cells)
    out = fx.registry.join(cont, "pair_id", "left").join(f1, "pair_id", "left")
    status = F.when(F.coalesce(F.col("n_common"), F.lit(0)) == 0, "no_common_rows").otherwise("ok")
    return out.select("pair_id", "model_a", "model_b", "name", "category", status.alias("status"),
                      *[F.col(c).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_common", "both_correct",
                                                                   "both_wrong", "b", "c")],
                      r6("chi2").alias("chi2"), "stars", r6("f1_a").alias("f1_a"), r6("f1_b").alias("f1_b"),
                      r6(F.col("f1_b") - F.col("f1_a")).alias("delta_f1"))


@register("C6_bootstrap_multinomial")
def q_c6(spark, sf):
    """Rows-only: 2000 multinomial replicates per pair (distribution checked
    against C6h in pytest)."""
    return C.bootstrap_delta_f1(_cells(spark, sf), 2000, 42)


@register("C9_compare_all_multinomial")
def q_c9m(spark, sf):
    fx = _fx(spark, sf)
    return C.compare_all(fx.predictions, fx.registry, reps=2000, method="multinomial", with_p=True)


_AVG = [("cells", "select model, actual_label, predicted_label, count(*) as n from fx_predictions group by all"),
        ("st", class_stats_sql("cells", ["model"])), ("s", summary_sql("st", ["model"]))]


@register("C1_compare_models", sql(["fx_predictions"], *_AVG, final="""
select model, round(f1, 6) as macro_f1, cast(row_number() over (order by round(f1, 6) desc, model) as integer) as rank,
       row_number() over (order by round(f1, 6) desc, model) = 1 as is_best from s"""))
def q_c1(spark, sf):
    return C.compare_models(_fx(spark, sf).predictions)


@register("C2_ablation_deltas", sql(["fx_predictions"], *_AVG, final="""
select model, round(f1, 6) as macro_f1, round(round(f1, 6) - (select round(f1, 6) from s where model = 'A'), 6) as delta,
       round(f1, 6) - (select round(f1, 6) from s where model = 'A') < -0.01 as degraded from s"""))
def q_c2(spark, sf):
    return C.ablation_deltas(_fx(spark, sf).predictions, "A", 0.01)


@register("C8_verdict", f"select pair_id, verdict from ({_c9_sql('row_id')}) v")
def q_c8(spark, sf):
    """The combined McNemar + bootstrap-CI conclusion per pair."""
    return q_c9(spark, sf).select("pair_id", "verdict")
