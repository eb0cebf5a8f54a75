"""Registered queries: group fairness (G), errors (E, P10, P11, J1) and
distributions (A1-A3, A5, A6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import errors as E
from evalspark.operators import groups as G
from evalspark.operators import stats as S
from evalspark.plans.oracle import sql
from evalspark.plans.q_metrics import GCELLS, class_stats_sql, summary_sql
from evalspark.plans.registry import register
from evalspark.sources.fixtures import Fixtures

_G1 = [GCELLS, ("st", class_stats_sql("gcells", ["model", "grp"])), ("s", summary_sql("st", ["model", "grp"])),
       ("g1", """select model, grp, cast(support as bigint) as n_examples, round(acc, 6) as accuracy,
                 round(f1, 6) as f1_macro, cast(n_correct as bigint) as n_correct,
                 cast(support - n_correct as bigint) as n_errors from s""")]


def _g1(spark, sf):
    return G.group_stats(Fixtures(spark, sf).predictions)


@register("G1_group_stats", sql(["fx_predictions"], *_G1, final="select * from g1"))
def q_g1(spark, sf):
    return _g1(spark, sf)


@register("G2_group_dispersion", sql(["fx_predictions"], *_G1, final="""
select model, count(f1_macro) as n_groups, round(avg(f1_macro), 6) as mean, round(stddev_pop(f1_macro), 6) as std,
       round(min(f1_macro), 6) as min, round(max(f1_macro), 6) as max, round(max(f1_macro) - min(f1_macro), 6) as range,
       round(case when avg(f1_macro) <> 0 then stddev_pop(f1_macro) / avg(f1_macro) * 100 end, 6) as cv_pct
from g1 group by model"""))
def q_g2(spark, sf):
    return G.group_dispersion(_g1(spark, sf))


@register("G3_groups_vs_mean", sql(["fx_predictions"], *_G1, final="""
select model, grp, f1_macro as f1, round(f1_macro - m, 6) as delta, round(f1_macro, 9) >= round(m, 9) as above_mean
from (select *, avg(f1_macro) over (partition by model) as m from g1) x"""))
def q_g3(spark, sf):
    return G.groups_vs_mean(_g1(spark, sf))


@register("G4_best_worst_groups", sql(["fx_predictions"], *_G1, ("r", """
select *, row_number() over (partition by model order by round(f1_macro, 9) desc, grp asc) as b,
          row_number() over (partition by model order by round(f1_macro, 9) asc, grp desc) as w from g1"""), final="""
select 'best' as side, cast(b as integer) as rank, model, grp, f1_macro as f1, accuracy, n_examples, n_errors from r where b <= 5
union all
select 'worst', cast(w as integer), model, grp, f1_macro, accuracy, n_examples, n_errors from r where w <= 5"""))
def q_g4(spark, sf):
    return G.best_worst_groups(_g1(spark, sf), 5)


@register("A5_histogram_group_f1", sql(["fx_predictions"], *_G1, ("rg", """
select model, case when max(f1_macro) = min(f1_macro) then min(f1_macro) - 0.5 else min(f1_macro) end as lo,
       case when max(f1_macro) = min(f1_macro) then max(f1_macro) + 0.5 else max(f1_macro) end as hi
from g1 group by model"""), ("c", """
select g1.model, cast(least(floor((f1_macro - lo) * (15.0 / (hi - lo))), 14) as integer) as bin, count(*) as n
from g1 join rg on g1.model = rg.model group by all"""), final="""
select rg.model, b.bin, round(lo + b.bin * (hi - lo) / 15, 6) as bin_lo, round(lo + (b.bin + 1) * (hi - lo) / 15, 6) as bin_hi,
       cast(coalesce(c.n, 0) as bigint) as n
from rg cross join (select cast(range as integer) as bin from range(0, 15)) b
left join c on c.model = rg.model and c.bin = b.bin"""))
def q_a5(spark, sf):
    return S.histogram(_g1(spark, sf), "f1_macro", 15, by=["model"])


@register("A6_five_number_group_f1", sql(["fx_predictions"], *_G1, ("q", """
select model, quantile_cont(f1_macro, 0.25) as q1, quantile_cont(f1_macro, 0.5) as median,
       quantile_cont(f1_macro, 0.75) as q3 from g1 group by model"""), final="""
select q.model, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(q3 - q1, 6) as iqr,
       round(min(case when f1_macro >= q1 - 1.5 * (q3 - q1) then f1_macro end), 6) as whisker_lo,
       round(max(case when f1_macro <= q3 + 1.5 * (q3 - q1) then f1_macro end), 6) as whisker_hi,
       count(case when f1_macro < q1 - 1.5 * (q3 - q1) or f1_macro > q3 + 1.5 * (q3 - q1) then 1 end) as n_outliers
from g1 join q on g1.model = q.model group by q.model, q1, median, q3"""))
def q_a6(spark, sf):
    return S.five_number(_g1(spark, sf), "f1_macro", by=["model"])


_LENGTHS = ("x", "select source, length(text) as n_chars from documents where text is not null")


def _lengths(spark, sf):
    return Fixtures(spark, sf).table("documents").select("source", F.char_length("text").alias("n_chars"))


@register("A6_five_number_text_length", sql([], _LENGTHS, ("q", """
select source, quantile_cont(n_chars, 0.25) as q1, quantile_cont(n_chars, 0.5) as median,
       quantile_cont(n_chars, 0.75) as q3 from x group by source"""), final="""
select q.source, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(q3 - q1, 6) as iqr,
       round(cast(min(case when n_chars >= q1 - 1.5 * (q3 - q1) then n_chars end) as double), 6) as whisker_lo,
       round(cast(max(case when n_chars <= q3 + 1.5 * (q3 - q1) then n_chars end) as double), 6) as whisker_hi,
       count(case when n_chars < q1 - 1.5 * (q3 - q1) or n_chars > q3 + 1.5 * (q3 - q1) then 1 end) as n_outliers
from x join q on x.source is not distinct from q.source group by q.source, q1, median, q3"""))
def q_a6_length(spark, sf):
    return S.five_number(_lengths(spark, sf), "n_chars", by=["source"])


@register("A6_quantiles_text_length", sql([], _LENGTHS, final="""
select source, n, cast(q as double) as q, round(cast(v as double), 6) as value from (
select source, count(*) as n, unnest([0.01, 0.1, 0.5, 0.9, 0.99, 0.999]) as q,
       unnest(quantile_cont(n_chars, [0.01, 0.1, 0.5, 0.9, 0.99, 0.999])) as v from x group by source) y"""))
def q_a6_quantiles(spark, sf):
    return S.quantiles(_lengths(spark, sf), "n_chars", (0.01, 0.1, 0.5, 0.9, 0.99, 0.999), by=["source"])


@register("A1_value_counts_label", sql(["fx_samples"], final="""
select label as value, count(*) as n from fx_samples where label is not null group by label"""))
def q_a1(spark, sf):
    return S.value_counts(Fixtures(spark, sf).samples, "label")


@register("A1_value_counts_group", sql(["fx_samples"], final="""
select grp as value, count(*) as n from fx_samples where grp is not null group by grp"""))
def q_a1g(spark, sf):
    return S.value_counts(Fixtures(spark, sf).samples, "grp")


@register("A2_value_shares_top10_groups", sql(["fx_samples"], ("t", """
select grp as value, count(*) as n from fx_samples where grp is not null group by grp order by n desc, grp limit 10"""),
    final="select value, n, round(n * 100.0 / (select sum(n) from t), 6) as pct from t"))
def q_a2(spark, sf):
    return S.value_shares(Fixtures(spark, sf).samples, "grp", top=10)


@register("A2_value_shares_label", sql(["fx_samples"], ("t", """
select label as value, count(*) as n from fx_samples where label is not null group by label"""),
    final="select value, n, round(n * 100.0 / (select sum(n) from t), 6) as pct from t"))
def q_a2l(spark, sf):
    return S.value_shares(Fixtures(spark, sf).samples, "label")


@register("A3_distinct_count", sql(["fx_samples"], final="""
select label, count(distinct grp) as n_distinct from fx_samples group by label"""))
def q_a3(spark, sf):
    return S.distinct_count(Fixtures(spark, sf).samples, "grp", by=["label"])


@register("P10_errors", sql(["fx_predictions"], final="""
select * from fx_predictions where actual_label <> predicted_label"""))
def q_p10(spark, sf):
    return E.errors(Fixtures(spark, sf).predictions)


@register("P11_error_bucket", sql(["fx_predictions3"], final="""
select *, case when actual_label = predicted_label then 'correct' when actual_label = 1 then 'FN'
               when predicted_label = 1 then 'FP' else 'other' end as bucket from fx_predictions3"""))
def q_p11(spark, sf):
    return E.error_bucket(Fixtures(spark, sf).predictions3, positive=1)


_J1 = ("src", "select text as k, min(row_id) as original_line_number, count(*) as n_source_matches from fx_samples group by text")


@register("J1_attach_source_line", sql(["fx_predictions", "fx_samples"], _J1, final="""
select p.*, s.original_line_number, cast(coalesce(s.n_source_matches, 0) as bigint) as n_source_matches
from fx_predictions p left join src s on p.text = s.k"""))
def q_j1(spark, sf):
    fx = Fixtures(spark, sf)
    return E.attach_source_line(fx.predictions, fx.samples)


@register("E1_error_rate", sql(["fx_predictions"], final="""
select model, cast(count_if(actual_label <> predicted_label) as bigint) as n_errors, count(*) as n_total,
       round(count_if(actual_label <> predicted_label) * 100.0 / count(*), 6) as error_pct
from fx_predictions group by model"""))
def q_e1(spark, sf):
    return E.error_rate(Fixtures(spark, sf).predictions)


@register("E2_error_table", sql(["fx_predictions", "fx_samples"], _J1, final="""
select s.original_line_number, cast(coalesce(s.n_source_matches, 0) as bigint) as n_source_matches, p.*
from fx_predictions p left join src s on p.text = s.k where p.actual_label <> p.predicted_label"""))
def q_e2(spark, sf):
    fx = Fixtures(spark, sf)
    return E.error_table(fx.predictions, fx.samples)


@register("E3_error_count_by_group", sql(["fx_predictions"], final="""
select model, grp, count(*) as error_count from fx_predictions
where actual_label <> predicted_label and grp is not null group by model, grp"""))
def q_e3(spark, sf):
    return E.error_count_by_group(Fixtures(spark, sf).predictions)


@register("E4_error_summary_by_group", sql(["fx_predictions"], final="""
select model, grp, count(*) as error_count, round(avg(predicted_probability), 6) as average_probability
from fx_predictions where actual_label <> predicted_label and grp is not null group by model, grp"""))
def q_e4(spark, sf):
    return E.error_summary_by_group(Fixtures(spark, sf).predictions)


def _e5_sql(fx):
    return sql([fx], ("ec", f"""select model, actual_label, predicted_label, count(*) as n from {fx}
                                where actual_label <> predicted_label group by all"""), final="""
select * from (select model, actual_label, predicted_label, n,
                      round(n * 100.0 / sum(n) over (partition by model), 6) as pct_of_errors,
                      cast(row_number() over (partition by model order by n desc, actual_label, predicted_label) as integer) as rank
               from ec) x where rank <= 10""")


@register("E5_error_types", _e5_sql("fx_predictions"))
def q_e5(spark, sf):
    return E.error_types(Fixtures(spark, sf).predictions)


@register("E5_error_types_3class", _e5_sql("fx_predictions3"))
def q_e5_3(spark, sf):
    return E.error_types(Fixtures(spark, sf).predictions3)


_AC = [("cells", "select model, actual_label, predicted_label, count(*) as n from fx_predictions3 group by all"),
       ("ac", """select c.* from cells c where exists (select 1 from cells d where d.model = c.model
                 and d.actual_label = c.predicted_label)""")]


@register("E6_errors_by_class", sql(["fx_predictions3"], *_AC, final="""
select model, actual_label, cast(sum(n) as bigint) as total,
       cast(sum(case when actual_label = predicted_label then n else 0 end) as bigint) as correct,
       cast(sum(n) - sum(case when actual_label = predicted_label then n else 0 end) as bigint) as errors,
       round(sum(case when actual_label = predicted_label then n else 0 end) / sum(n), 6) as accuracy
from ac group by model, actual_label"""))
def q_e6(spark, sf):
    return E.errors_by_class(Fixtures(spark, sf).predictions3)


@register("E6_main_confusions", sql(["fx_predictions3"], *_AC, final="""
select model, actual_label, predicted_label, n, round(n / t, 6) as share
from (select *, sum(n) over (partition by model, actual_label) as t from ac) x
where actual_label <> predicted_label and n > 0"""))
def q_e6b(spark, sf):
    return E.main_confusions(Fixtures(spark, sf).predictions3)


@register("E7_fn_fp_distribution", sql(["fx_predictions3"], ("b", """
select model, case when actual_label = 1 then 'FN' when predicted_label = 1 then 'FP' else 'other' end as bucket,
       count(*) as n from fx_predictions3 where actual_label <> predicted_label group by all"""), final="""
select model, bucket, n, round(n * 100.0 / sum(n) over (partition by model), 6) as pct_of_errors from b"""))
def q_e7(spark, sf):
    return E.fn_fp_distribution(Fixtures(spark, sf).predictions3, positive=1)


_E8 = ("t", """select * from (select *, cast(row_number() over (partition by model order by predicted_probability desc nulls last,
                row_id) as integer) as rank from fx_predictions where actual_label <> predicted_label) x where rank <= {n}""")


@register("E8_top_failures", sql(["fx_predictions"], (_E8[0], _E8[1].format(n=50)), final="select * from t"))
def q_e8(spark, sf):
    return E.top_failures(Fixtures(spark, sf).predictions, 50)


@register("E8_top_failures_no_probability", sql(["fx_predictions3"], ("t", """
select * from (select *, cast(row_number() over (partition by model order by row_id) as integer) as rank from fx_predictions3
               where actual_label <> predicted_label) x where rank <= 100"""), final="select * from t"))
def q_e8b(spark, sf):
    return E.top_failures(Fixtures(spark, sf).predictions3, 100)


@register("E9_failure_digest", sql(["fx_predictions"], (_E8[0], _E8[1].format(n=20)), final="""
select model, rank as case_no, concat(substr(text, 1, 200), '...') as snippet, actual_label, predicted_label,
       round(predicted_probability, 6) as confidence, grp from t"""))
def q_e9(spark, sf):
    return E.failure_digest(Fixtures(spark, sf).predictions, 20)
