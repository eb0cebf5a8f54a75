"""Registered queries: sampling and splitting (SA1-SA5, P17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import sample as SA
from evalspark.plans.oracle import sql
from evalspark.plans.registry import register
from evalspark.sources.fixtures import Fixtures


def _quota_sql(src: str, strata: str, key: str, total_expr: str) -> list[tuple[str, str]]:
    """Window-form oracle of the stratified pick: rank every row of a stratum
    by md5(seed:key), key and keep the first quota rows."""
    return [
        ("h", f"select *, md5('42:' || cast({key} as varchar)) as hh from {src}"),
        ("per", f"select {strata} as s, count(*) as nc from h group by {strata}"),
        ("tot", f"select sum(nc) as n, {total_expr} as t from per"),
        ("q1", "select s, nc, (t * nc) // n as fl, (t * nc) % n as rem, t from per, tot"),
        ("q2", "select s, fl + case when row_number() over (order by rem desc, s nulls first) <= t - sum(fl) over () then 1 else 0 end as quota from q1"),
        ("picked", f"""select h.*, row_number() over (partition by h.{strata} order by hh, {key}) <= q2.quota as picked
                       from h join q2 on h.{strata} is not distinct from q2.s"""),
    ]


@register("SA2_split_stratified", sql(["fx_samples"], *_quota_sql(
    "fx_samples", "label", "row_id", "cast(ceil(0.2::double * sum(nc)) as bigint)"), final="""
select row_id, label, grp, case when picked then 'test' else 'train' end as split from picked"""))
def q_sa2(spark, sf):
    s = SA.split_stratified(Fixtures(spark, sf).samples, 0.2, "label", "row_id", 42)
    return s.select("row_id", "label", "grp", "split")


@register("SA2_split_null_stratum", sql(["fx_samples_null"], *_quota_sql(
    "fx_samples_null", "label", "row_id", "cast(ceil(0.2::double * sum(nc)) as bigint)"), final="""
select row_id, label, case when picked then 'test' else 'train' end as split from picked"""))
def q_sa2n(spark, sf):
    return SA.split_stratified(Fixtures(spark, sf).samples_null.select("row_id", "label"), 0.2)


@register("SA4_sample_null_label", sql(["fx_samples_null"], final="""
select row_id, label from (
  select *, row_number() over (partition by label order by md5('42:' || cast(row_id as varchar)), row_id) as rn
  from fx_samples_null where label is not null) x
where rn <= 30 // (select count(distinct label) from fx_samples_null)"""))
def q_sa4n(spark, sf):
    return SA.sample_equal_per_class(Fixtures(spark, sf).samples_null.select("row_id", "label"), 30)


@register("SA2_split_stratified_documents", sql([], *_quota_sql(
    "(select doc_id, lang from documents)", "lang", "doc_id", "cast(ceil(0.2::double * sum(nc)) as bigint)"), final="""
select doc_id, lang, case when picked then 'test' else 'train' end as split from picked"""))
def q_sa2d(spark, sf):
    d = Fixtures(spark, sf).table("documents").select("doc_id", "lang")
    return SA.split_stratified(d, 0.2, "lang", "doc_id", 42)


@register("SA3_split_random", sql(["fx_samples"], *_quota_sql(
    "(select *, 0 as one from fx_samples)", "one", "row_id", "cast(ceil(0.2::double * sum(nc)) as bigint)"), final="""
select row_id, label, case when picked then 'test' else 'train' end as split from picked"""))
def q_sa3(spark, sf):
    return SA.split_random(Fixtures(spark, sf).samples, 0.2, "row_id", 42).select("row_id", "label", "split")


@register("SA1_downsample_stratified", sql(["fx_samples"], *_quota_sql(
    "fx_samples", "label", "row_id", "least(100, sum(nc))"), final="""
select row_id, label, grp from picked where picked"""))
def q_sa1(spark, sf):
    return SA.downsample_stratified(Fixtures(spark, sf).samples, 100).select("row_id", "label", "grp")


@register("SA4_sample_equal_per_class", sql(["fx_samples"], final="""
select row_id, label, grp from (
  select *, row_number() over (partition by label order by md5('42:' || cast(row_id as varchar)), row_id) as rn
  from fx_samples) x
where rn <= 30 // (select count(distinct label) from fx_samples)"""))
def q_sa4(spark, sf):
    return SA.sample_equal_per_class(Fixtures(spark, sf).samples, 30).select("row_id", "label", "grp")


@register("SA5_sample_top_groups", sql(["fx_samples"], ("tops", """
select grp from fx_samples where grp is not null group by grp order by count(*) desc, grp limit 5"""), final="""
select row_id, label, grp from (
  select *, row_number() over (partition by grp order by md5('42:' || cast(row_id as varchar)), row_id) as rn
  from fx_samples where grp in (select grp from tops)) x
where rn <= 3"""))
def q_sa5(spark, sf):
    return SA.sample_top_groups(Fixtures(spark, sf).samples, 5, 3).select("row_id", "label", "grp")


@register("P17_shuffle", sql(["fx_samples"], final="""
select row_id, label, md5('42:' || cast(row_id as varchar)) as shuffle_key from fx_samples"""))
def q_p17(spark, sf):
    return SA.shuffle(Fixtures(spark, sf).samples.select("row_id", "label"))
