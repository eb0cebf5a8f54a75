"""Registered queries: classification metrics."""

from __future__ import annotations

from evalspark.functions.columns import r6
from evalspark.operators import metrics as M
from evalspark.plans.oracle import sql
from evalspark.plans.registry import register
from evalspark.sources.fixtures import Fixtures
from pyspark.sql import functions as F


def class_stats_sql(cells: str, keys: list[str]) -> str:
    """DuckDB: per-label tp / support / predicted count and P, R, F1."""
    kc = "".join(f"{k}, " for k in keys)
    return f"""
select {kc}label, sum(tp)::double as tp, sum(support)::double as support, sum(pred_n)::double as pred_n,
       case when sum(pred_n) > 0 then sum(tp)::double / sum(pred_n) else 0.0 end as prec,
       case when sum(support) > 0 then sum(tp)::double / sum(support) else 0.0 end as rec,
       case when sum(support) + sum(pred_n) > 0 then 2.0 * sum(tp)::double / (sum(support) + sum(pred_n)) else 0.0 end as f1
from (select {kc}actual_label as label, case when actual_label = predicted_label then n else 0 end as tp,
             n as support, 0 as pred_n from {cells}
      union all
      select {kc}predicted_label as label, 0 as tp, 0 as support, n as pred_n from {cells}) e
group by {kc}label"""


def summary_sql(stats: str, keys: list[str]) -> str:
    kc = "".join(f"{k}, " for k in keys)
    gb = f"group by {', '.join(keys)}" if keys else ""
    return f"""
select {kc}avg(prec) as prec, avg(rec) as rec, avg(f1) as f1,
       avg(case when support > 0 then rec end) as bal,
       sum(prec * support) / sum(support) as w_prec, sum(rec * support) / sum(support) as w_rec,
       sum(f1 * support) / sum(support) as w_f1, sum(tp) / sum(support) as acc, sum(tp) as n_correct,
       sum(support) as support
from {stats} {gb}"""


CELLS = ("cells", "select model, actual_label, predicted_label, count(*) as n from fx_predictions group by all")
GCELLS = ("gcells", "select model, grp, actual_label, predicted_label, count(*) as n from fx_predictions "
                    "where grp is not null group by all")


@register("M1_confusion_cells", sql(["fx_predictions"], final="""
select model, case when grouping(grp) = 1 then 'overall' else 'group' end as scope, grp, actual_label,
       predicted_label, count(*) as n, round(sum(predicted_probability), 6) as sum_prob
from fx_predictions
group by grouping sets ((model, grp, actual_label, predicted_label), (model, actual_label, predicted_label))"""))
def q_m1(spark, sf):
    c = M.confusion_cells(Fixtures(spark, sf).predictions)
    return c.withColumn("sum_prob", r6("sum_prob"))


M2_SQL = [CELLS,
           ("labs", "select distinct model, actual_label as lab from cells"),
           ("grid", "select a.model, a.lab as actual_label, b.lab as predicted_label from labs a join labs b on a.model = b.model"),
           ("m", """select g.model, g.actual_label, g.predicted_label, cast(coalesce(c.n, 0) as bigint) as n
                    from grid g left join cells c on g.model = c.model and g.actual_label = c.actual_label
                    and g.predicted_label = c.predicted_label""")]


@register("M2_confusion_matrix", sql(["fx_predictions"], *M2_SQL, final="select * from m"))
def q_m2(spark, sf):
    return M.confusion_matrix(Fixtures(spark, sf).predictions)


@register("M2_confusion_matrix_3class", sql(["fx_predictions3"], *[
    (n, b.replace("fx_predictions", "fx_predictions3")) for n, b in M2_SQL], final="select * from m"))
def q_m2_3(spark, sf):
    return M.confusion_matrix(Fixtures(spark, sf).predictions3)


@register("M3_confusion_matrix_normalized", sql(["fx_predictions"], *M2_SQL, final="""
select model, actual_label, predicted_label, n,
       round(case when sum(n) over (partition by model, actual_label) > 0
                  then n / sum(n) over (partition by model, actual_label) else 0 end, 6) as row_share
from m"""))
def q_m3(spark, sf):
    return M.confusion_matrix_normalized(Fixtures(spark, sf).predictions)


@register("M4_class_report", sql(["fx_predictions"], CELLS, ("st", class_stats_sql("cells", ["model"])), final="""
select model, cast(label as varchar) as row_name, round(prec, 6) as "precision", round(rec, 6) as recall,
       round(f1, 6) as f1, cast(support as bigint) as support from st"""))
def q_m4(spark, sf):
    return M.class_report(Fixtures(spark, sf).predictions)


@register("M5_accuracy", sql(["fx_predictions"], final="""
select model, round(avg(case when actual_label = predicted_label then 1.0 else 0.0 end), 6) as accuracy,
       count(*) as support from fx_predictions group by model"""))
def q_m5(spark, sf):
    return M.accuracy(Fixtures(spark, sf).predictions)


_AVG_SQL = [CELLS, ("st", class_stats_sql("cells", ["model"])), ("s", summary_sql("st", ["model"]))]


@register("M6_M7_M8_averages", sql(["fx_predictions"], *_AVG_SQL, final="""
select model, round(prec, 6) as macro_precision, round(rec, 6) as macro_recall, round(f1, 6) as macro_f1,
       round(w_prec, 6) as weighted_precision, round(w_rec, 6) as weighted_recall, round(w_f1, 6) as weighted_f1,
       round(bal, 6) as balanced_accuracy, cast(support as bigint) as support from s"""))
def q_m678(spark, sf):
    return M.averages(Fixtures(spark, sf).predictions)


@register("M6_M7_M8_averages_3class", sql(["fx_predictions3"], *[
    (n, b.replace("fx_predictions", "fx_predictions3")) for n, b in _AVG_SQL], final="""
select model, round(prec, 6) as macro_precision, round(rec, 6) as macro_recall, round(f1, 6) as macro_f1,
       round(w_prec, 6) as weighted_precision, round(w_rec, 6) as weighted_recall, round(w_f1, 6) as weighted_f1,
       round(bal, 6) as balanced_accuracy, cast(support as bigint) as support from s"""))
def q_m678_3(spark, sf):
    return M.averages(Fixtures(spark, sf).predictions3)


@register("M9_full_report", sql(["fx_predictions"], *_AVG_SQL, final="""
select model, cast(label as varchar) as row_name, round(prec, 6) as "precision", round(rec, 6) as recall,
       round(f1, 6) as f1, cast(support as bigint) as support from st
union all select model, 'accuracy', null, null, round(acc, 6), cast(support as bigint) from s
union all select model, 'macro avg', round(prec, 6), round(rec, 6), round(f1, 6), cast(support as bigint) from s
union all select model, 'weighted avg', round(w_prec, 6), round(w_rec, 6), round(w_f1, 6), cast(support as bigint) from s"""))
def q_m9(spark, sf):
    return M.full_report(Fixtures(spark, sf).predictions)


def _m10_sql(fx: str) -> str:
    return sql([fx], (GCELLS[0], GCELLS[1].replace("fx_predictions", fx)),
               ("st", class_stats_sql("gcells", ["model", "grp"])), ("s", summary_sql("st", ["model", "grp"])),
               final="""
select model, grp, round(prec, 6) as "precision", round(rec, 6) as recall, round(f1, 6) as f1,
       round(bal, 6) as balanced_accuracy, cast(support as bigint) as support from s""")


@register("M10_metrics_by_group", _m10_sql("fx_predictions"))
def q_m10(spark, sf):
    return M.metrics_by_group(Fixtures(spark, sf).predictions)


@register("M10_metrics_by_group_3class", _m10_sql("fx_predictions3"))
def q_m10_3(spark, sf):
    return M.metrics_by_group(Fixtures(spark, sf).predictions3)


@register("M10_metrics_by_group_from_cells", _m10_sql("fx_predictions"))
def q_m10_cells(spark, sf):
    """Same result, computed from the fused grouping-sets cells (M1)."""
    return M.metrics_by_group(M.confusion_cells(Fixtures(spark, sf).predictions))


@register("M11_f1_per_class", sql(["fx_predictions"], CELLS, ("st", class_stats_sql("cells", ["model"])), final="""
select model, label as actual_label, round(f1, 6) as f1 from st where support > 0"""))
def q_m11(spark, sf):
    return M.f1_per_class(Fixtures(spark, sf).predictions)


_P12_SQL = ("am", """
select row_id, actual_label, cast(regexp_extract(e.label, '_(\\d+)$', 1) as integer) as predicted_label,
       e.score as predicted_probability
from (select row_id, actual_label, e, row_number() over (partition by row_id order by e.score desc, idx) as rn
      from (select row_id, actual_label, unnest(scores) as e, generate_subscripts(scores, 1) as idx from fx_scores) u) r
where rn = 1""")


@register("P12_argmax_scores", sql(["fx_scores"], _P12_SQL, final="select * from am"))
def q_p12(spark, sf):
    return M.argmax_scores(Fixtures(spark, sf).scores)


@register("M12_eval_metrics", sql(["fx_scores"], _P12_SQL,
                                  ("c", "select actual_label, predicted_label, count(*) as n from am group by all"),
                                  ("st", class_stats_sql("c", [])), ("s", summary_sql("st", [])), final="""
select round(prec, 6) as "precision", round(rec, 6) as recall, round(f1, 6) as f1,
       round(bal, 6) as balanced_accuracy from s"""))
def q_m12(spark, sf):
    return M.eval_metrics(Fixtures(spark, sf).scores)


@register("M2_confusion_matrix_wide", sql(["fx_predictions3"], *[
    (n, b.replace("fx_predictions", "fx_predictions3")) for n, b in M2_SQL], final="""
select model, actual_label,
       max(case when predicted_label = 0 then n end) as "0",
       max(case when predicted_label = 1 then n end) as "1",
       max(case when predicted_label = 2 then n end) as "2"
from m group by model, actual_label"""))
def q_m2w(spark, sf):
    return M.confusion_matrix_wide(Fixtures(spark, sf).predictions3, labels=[0, 1, 2])
