"""Registered queries: text features (T1-T5, T8, T12) and text-side prep."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.columns import r6
from evalspark.operators import errors as E
from evalspark.operators import prep as PR
from evalspark.operators import text as T
from evalspark.plans.oracle import sql
from evalspark.plans.registry import register
from evalspark.sources.fixtures import Fixtures

TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
DOCS = "(select doc_id as row_id, text from documents)"
TERMS = ("terms", f"""
select row_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as term
from (select row_id, {TOK} as t from {DOCS} d) x""")
TF = ("tf", "select row_id, term, count(*) as tf from terms group by all")


def _docs(spark, sf):
    return Fixtures(spark, sf).table("documents").select(F.col("doc_id").alias("row_id"), "text")


@register("T1_tokenize", sql([], final=f"""
select row_id, cast(generate_subscripts(t, 1) as integer) as pos, unnest(t) as token
from (select row_id, {TOK} as t from {DOCS} d) x"""))
def q_t1(spark, sf):
    return T.tokenize(_docs(spark, sf))


@register("T2_ngrams", sql([], TERMS, TF, final="select * from tf"))
def q_t2(spark, sf):
    return T.term_counts(_docs(spark, sf))


@register("T3_vocabulary", sql([], TERMS, TF, final="""
select term, cast(sum(tf) as bigint) as cnt, count(*) as df from tf group by term order by cnt desc, term limit 50000"""))
def q_t3(spark, sf):
    v = T.vocabulary(T.term_counts(_docs(spark, sf)), 50_000)
    return v.select("term", F.col("cnt").cast("bigint").alias("cnt"), "df")


@register("T4_tfidf", sql([], TERMS, TF, ("voc", """
select term, count(*) as df from tf group by term order by sum(tf) desc, term limit 50000"""), ("w", f"""
select tf.row_id, tf.term, tf.tf, ln((1.0 + (select count(*) from documents)) / (1.0 + voc.df)) + 1.0 as idf
from tf join voc on tf.term = voc.term"""), final="""
select row_id, term, tf, round(idf, 6) as idf,
       round(tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by row_id)), 6) as weight from w"""))
def q_t4(spark, sf):
    return T.tfidf_rounded(T.tfidf(_docs(spark, sf), max_features=50_000))


@register("T5_class_weights", sql(["fx_samples"], final="""
select label, count(*) as n_c,
       round((select count(*) from fx_samples) / ((select count(distinct label) from fx_samples) * count(*)), 6) as weight
from fx_samples group by label"""))
def q_t5(spark, sf):
    return T.class_weights(Fixtures(spark, sf).samples)


STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@register("T12_top_words", sql(["fx_predictions"], ("b", f"""
select model, case when actual_label = 1 then 'FN' when predicted_label = 1 then 'FP' else 'other' end as bucket,
       unnest(list_filter({TOK}, lambda x: not list_contains([{STOP}], x))) as word
from fx_predictions where actual_label <> predicted_label"""), final="""
select * from (select model, bucket, word, n,
                      cast(row_number() over (partition by model, bucket order by n desc, word) as integer) as rank
               from (select model, bucket, word, count(*) as n from b group by model, bucket, word) c) x
where rank <= 50"""))
def q_t12(spark, sf):
    e = E.error_bucket(E.errors(Fixtures(spark, sf).predictions), positive=1)
    return T.top_words(e, 50, ["model", "bucket"])


@register("P16_truncate_tokens", sql([], final=f"""
select row_id, cast(len(t) as integer) as n_tokens, cast(len(t[1:128]) as integer) as n_kept, len(t) > 128 as truncated,
       case when len(t) > 0 then t[least(len(t), 128)] end as last_kept
from (select row_id, {TOK} as t from {DOCS} d) x"""))
def q_p16(spark, sf):
    return PR.truncate_tokens(_docs(spark, sf), 128)


@register("P16_truncation_share", sql([], final=f"""
select count(*) as n_rows, cast(count_if(len(t) > 128) as bigint) as n_truncated,
       round(count_if(len(t) > 128) / count(*), 6) as share_truncated
from (select {TOK} as t from documents) x"""))
def q_p16s(spark, sf):
    return PR.truncation_share(_docs(spark, sf), 128)
