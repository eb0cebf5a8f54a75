"""Registered queries: explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.columns import hash_uniform, r6
from evalspark.operators import explain as X
from evalspark.operators import text as T
from evalspark.plans.oracle import U, sql
from evalspark.plans.q_text import TERMS, TF
from evalspark.plans.registry import register
from evalspark.sources.fixtures import Fixtures

STRIPLOW = "lower(regexp_replace(token, '^\\s+|\\s+$', '', 'g'))"


@register("X2_lime_top_words", sql(["fx_token_weights"], ("s", f"""
select case when weight > 0 then 'positive' else 'negative' end as direction, {STRIPLOW} as word,
       sum(abs(weight)) as t from fx_token_weights group by all"""), final="""
select direction, word, round(t, 6) as total, rank from (
  select *, cast(row_number() over (partition by direction order by t desc, word) as integer) as rank from s) x where rank <= 20"""))
def q_x2(spark, sf):
    return X.lime_top_words(Fixtures(spark, sf).token_weights, 20)


@register("X3_lime_digest", sql(["fx_token_weights", "fx_samples"], final="""
select x.row_id, token, round(weight, 6) as weight,
       case when weight > 0 then 'Stereotype' else 'Non-Stereotype' end as direction, rank,
       case when s.text is not null then concat(substr(s.text, 1, 100), '...') end as snippet, s.label
from (select *, cast(row_number() over (partition by row_id order by abs(weight) desc, pos) as integer) as rank from fx_token_weights) x
left join fx_samples s on s.row_id = x.row_id
where rank <= 5"""))
def q_x3(spark, sf):
    fx = Fixtures(spark, sf)
    return X.lime_digest(fx.token_weights, 5, examples=fx.samples)


@register("X5_group_digest", sql(["fx_samples"], ("top", """
select grp from (select grp, count(*) as n from fx_samples where grp is not null group by grp) c order by n desc, grp limit 5"""),
    ("picked", """
select * from (select *, cast(row_number() over (partition by grp order by md5(concat('42:', row_id)), row_id) as integer) as number
               from fx_samples where grp in (select grp from top)) x where number <= 3"""), final="""
select grp, count(*) over (partition by grp) as n_examples, number, row_id, concat(substr(text, 1, 80), '...') as snippet
from picked"""))
def q_x5_digest(spark, sf):
    from evalspark.operators.sample import sample_top_groups
    return X.group_digest(sample_top_groups(Fixtures(spark, sf).samples, 5, 3))


def _coef_col(term):
    return F.lit(2.0) * hash_uniform(F.concat(F.lit("c:"), term)) - F.lit(1.0)


@register("X4a_linear_shap", sql([], TERMS, TF, ("voc", """
select term, count(*) as df from tf group by term order by sum(tf) desc, term limit 50000"""), ("w", """
select tf.row_id, tf.term, tf.tf * (ln((1.0 + (select count(*) from documents)) / (1.0 + voc.df)) + 1.0) as w
from tf join voc on tf.term = voc.term"""), ("x", """
select row_id, term, w / sqrt(sum(w * w) over (partition by row_id)) as weight from w"""), ("cm", f"""
select v.term, 2.0 * {U("concat('c:', v.term)")} - 1.0 as coef,
       coalesce(m.mean, 0.0) as mean
from voc v left join (select term, sum(weight) / (select count(*) from documents) as mean from x group by term) m
  on m.term = v.term"""), ("pr", """
select x.row_id, x.term, cm.coef * (x.weight - cm.mean) as phi, cm.coef * cm.mean as c_m
from x join cm on x.term = cm.term"""), final="""
select row_id, term, round(phi, 6) as phi from pr
union all
select d.doc_id, '<absent>', round(-((select sum(coef * mean) from cm) - coalesce(p.s, 0.0)), 6)
from documents d left join (select row_id, sum(c_m) as s from pr group by row_id) p on p.row_id = d.doc_id"""))
def q_x4a(spark, sf):
    docs = Fixtures(spark, sf).table("documents").select(F.col("doc_id").alias("row_id"), "text")
    terms = T.vocabulary(T.term_counts(docs), 50_000)  # features and coefficients have the same terms
    feats = T.tfidf(docs, max_features=50_000, terms=terms).select("row_id", "term", "weight")
    coef = terms.select("term", _coef_col(F.col("term")).alias("coef"))
    out = X.linear_shap(feats, coef, docs.select("row_id"))
    return out.select("row_id", "term", r6("phi").alias("phi"))


def _scorer():
    from evalspark.operators.models import lexicon_predictor_factory
    return lexicon_predictor_factory()


@register("X1_explain_lime")
def q_x1(spark, sf):
    """Rows-only: LIME weights of 3 samples from each of the 5 largest
    groups, scored by the batch-scoring hook."""
    from evalspark.operators.sample import sample_top_groups
    s = sample_top_groups(Fixtures(spark, sf).samples, 5, 3)
    return X.explain_lime(s.select("row_id", "text"), _scorer(), num_samples=1000, num_features=10)


@register("X4b_explain_shap_sampled")
def q_x4b(spark, sf):
    from evalspark.operators.sample import sample_top_groups
    s = sample_top_groups(Fixtures(spark, sf).samples, 5, 3)
    return X.explain_shap_sampled(s.select("row_id", "text"), _scorer())


@register("X4b_shap_additivity", sql(["fx_samples"], ("top", """
select grp from (select grp, count(*) as n from fx_samples where grp is not null group by grp) c order by n desc, grp limit 5"""),
    ("picked", """
select * from (select *, row_number() over (partition by grp order by md5(concat('42:', row_id)), row_id) as number
               from fx_samples where grp in (select grp from top)) x where number <= 3"""), ("toks", """
select row_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) as word from picked"""), final=f"""
select row_id, count(distinct word) as n_words,
       round(1.0 / (1.0 + exp(-sum(2.0 * {U("word")} - 1.0) / sqrt(count(*)))) - 0.5, 6) as phi_sum
from toks group by row_id"""))
def q_x4b_additivity(spark, sf):
    """The values of an instance sum to the score of its text less that of the empty text."""
    from evalspark.operators.models import hashed_predictor_factory
    from evalspark.operators.sample import sample_top_groups
    s = sample_top_groups(Fixtures(spark, sf).samples, 5, 3)
    phi = X.explain_shap_sampled(s.select("row_id", "text"), hashed_predictor_factory)
    return phi.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_words"), r6(F.sum("phi")).alias("phi_sum"))


@register("X5_explain_by_group")
def q_x5(spark, sf):
    return X.explain_by_group(Fixtures(spark, sf).samples, _scorer(), 5, 3, num_samples=1000)
