"""Registered queries: projections and scalar logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.columns import safe_partition_name
from evalspark.operators import prep as PR
from evalspark.plans.oracle import sql
from evalspark.plans.registry import register
from evalspark.sources import io as IO
from evalspark.sources.fixtures import Fixtures


def _fx(spark, sf):
    return Fixtures(spark, sf)


@register("P1_pick_by_direction", sql(["fx_pairs"], final="""
select row_id, stereo_antistereo, case when stereo_antistereo is not distinct from 'stereo' then sent_more else sent_less end as text
from fx_pairs"""))
def q_p1(spark, sf):
    return PR.pick_by_direction(_fx(spark, sf).pairs).select("row_id", "stereo_antistereo", "text")


@register("P2_with_constant", sql(["fx_samples"], final="""
select row_id, label, 'docs' as data_name, 1 as version from fx_samples"""))
def q_p2(spark, sf):
    s = _fx(spark, sf).samples.select("row_id", "label")
    return PR.with_constant(PR.with_constant(s, "data_name", "docs"), "version", 1)


@register("P3_project_rename", sql(["fx_pairs"], final="""
select row_id, sent_more as text, bias_type as grp from fx_pairs"""))
def q_p3(spark, sf):
    return PR.project_rename(_fx(spark, sf).pairs, {"row_id": "row_id", "text": "sent_more", "grp": "bias_type"})


@register("P4_drop_incomplete", sql(["fx_pairs"], final="""
select row_id, case when stereo_antistereo is not distinct from 'stereo' then sent_more else sent_less end as text,
       'stereotype' as label, bias_type as grp
from fx_pairs
where (case when stereo_antistereo is not distinct from 'stereo' then sent_more else sent_less end) is not null
  and bias_type is not null"""))
def q_p4(spark, sf):
    return PR.pairs_to_samples(_fx(spark, sf).pairs)


@register("P5_binarize_label", sql(["fx_samples"], final="""
select row_id, label, cast(label = 'stereotype' as integer) as label_int from fx_samples"""))
def q_p5(spark, sf):
    return PR.binarize_label(_fx(spark, sf).samples.select("row_id", "label"))


@register("P5_binarize_null_label", sql(["fx_samples_null"], final="""
select row_id, label, cast(coalesce(label = 'stereotype', false) as integer) as label_int from fx_samples_null"""))
def q_p5n(spark, sf):
    return PR.binarize_label(_fx(spark, sf).samples_null.select("row_id", "label"))


@register("P7_drop_labels_null_label", sql(["fx_samples_null"], final="""
select row_id, label, grp from fx_samples_null where label is distinct from 'unrelated'"""))
def q_p7n(spark, sf):
    return PR.drop_labels(_fx(spark, sf).samples_null.select("row_id", "label", "grp"), ["unrelated"])


@register("P6_encode_label", sql(["fx_samples"], final="""
select row_id, label, case label when 'stereotype' then 0 when 'neutral' then 1 when 'unrelated' then 2 end as label_id
from (select row_id, label from fx_samples union all select row_id + 1000000000, 'other' from fx_samples where row_id % 7 = 0) x"""))
def q_p6(spark, sf):
    s = _fx(spark, sf).samples.select("row_id", "label")
    extra = s.where(F.col("row_id") % 7 == 0).select((F.col("row_id") + 1000000000).alias("row_id"),
                                                      F.lit("other").alias("label"))
    return PR.encode_label(s.unionByName(extra))


@register("P7_drop_labels", sql(["fx_samples"], final="""
select row_id, label, grp from fx_samples where label not in ('unrelated')"""))
def q_p7(spark, sf):
    return PR.drop_labels(_fx(spark, sf).samples.select("row_id", "label", "grp"), ["unrelated"])


@register("P8_attach_row_id", sql([], final="""
select doc_id, lang, doc_id as row_id from documents"""))
def q_p8(spark, sf):
    d = _fx(spark, sf).table("documents").select("doc_id", "lang")
    return PR.attach_row_id(d, "doc_id")


@register("P9_reorder_columns", sql(["fx_predictions"], final="""
select row_id, model, actual_label, predicted_label from fx_predictions"""))
def q_p9(spark, sf):
    p = _fx(spark, sf).predictions.select("model", "actual_label", "predicted_label", "row_id")
    return PR.reorder_columns(p, ["row_id"])


@register("P13_label_display", sql(["fx_predictions3"], final="""
select model, row_id, actual_label,
       case cast(actual_label as varchar) when '1' then 'Stereotype' when '0' then 'Non-Stereotype'
            else cast(actual_label as varchar) end as label_name
from fx_predictions3"""))
def q_p13(spark, sf):
    return PR.label_display(_fx(spark, sf).predictions3.select("model", "row_id", "actual_label"))


@register("P14_snippet", sql(["fx_samples"], final="""
select row_id, concat(substr(text, 1, 100), '...') as snippet from fx_samples"""))
def q_p14(spark, sf):
    return PR.snippet(_fx(spark, sf).samples.select("row_id", "text"), 100).drop("text")


@register("P15_preview", sql(["fx_samples"], final="""
select row_id, label, grp from fx_samples order by row_id limit 5"""))
def q_p15(spark, sf):
    return PR.preview(_fx(spark, sf).samples.select("row_id", "label", "grp"), 5)


@register("S2_read_samples", sql([], final="""
select doc_id as row_id, text, source as grp from documents"""))
def q_s2(spark, sf):
    return IO.read_samples(spark, f"{sf}/documents.parquet", {"row_id": "doc_id", "text": "text", "grp": "source"})


@register("S8_safe_partition_name", sql([], final="""
select doc_id, replace(concat(lang, '/', source), '/', '_') as folder from documents"""))
def q_s8(spark, sf):
    d = _fx(spark, sf).table("documents")
    return d.select("doc_id", safe_partition_name(F.concat("lang", F.lit("/"), "source")).alias("folder"))


@register("S3_read_predictions", sql([], final="""
select doc_id, quality, toxic, 'quality_run' as model from labels
union all select doc_id, quality, toxic, 'toxic_run' as model from labels"""))
def q_s3(spark, sf):
    """One result table per run, tagged with its name and unioned by column
    name (both runs read the given labels table)."""
    return IO.read_predictions(spark, {"quality_run": f"{sf}/labels.parquet", "toxic_run": f"{sf}/labels.parquet"})
