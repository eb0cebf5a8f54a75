"""Registered queries: prompts, response parsing, variants, union, dataset
statistics (V1-V4, U1, A4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import generate as V
from evalspark.operators import stats as S
from evalspark.plans.oracle import sql
from evalspark.plans.registry import register
from evalspark.sources.fixtures import Fixtures

_BEFORE, _, _AFTER = V.DEFAULT_TEMPLATE.partition("{text}")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

_NEU = "starts_with(l, 'NEUTRE:') or starts_with(l, 'Neutre:')"
_UNR = "starts_with(l, 'SANS_RAPPORT:') or starts_with(l, 'Sans rapport:')"
PARSED = ("parsed", f"""
select row_id, grp,
       coalesce({STRIP.format(x="substr(nl, strpos(nl, ':') + 1)")}, '') as neutral,
       coalesce({STRIP.format(x="substr(ul, strpos(ul, ':') + 1)")}, '') as unrelated
from (select row_id, grp,
             list_last(list_filter(ls, lambda l: {_NEU})) as nl,
             list_last(list_filter(ls, lambda l: not ({_NEU}) and ({_UNR}))) as ul
      from (select row_id, grp,
                   list_transform(string_split(coalesce(response, ''), chr(10)), lambda l: {STRIP.format(x="l")}) as ls
            from fx_responses) a) b""")

VARIANTS = ("variants", """
select row_id, 'neutral' as origin, neutral as text, 'neutral' as label, grp from parsed where neutral <> ''
union all
select row_id, 'unrelated', unrelated, 'unrelated', grp from parsed where unrelated <> ''""")


@register("V1_build_prompt", sql(["fx_samples"], final=f"""
select row_id, {STRIP.format(x=f"concat({_q(_BEFORE)}, text, {_q(_AFTER)})")} as prompt from fx_samples"""))
def q_v1(spark, sf):
    return V.build_prompt(Fixtures(spark, sf).samples).select("row_id", "prompt")


@register("V3_parse_response", sql(["fx_responses"], PARSED, final="select * from parsed"))
def q_v3(spark, sf):
    return V.parse_response(Fixtures(spark, sf).responses).drop("response")


@register("V4_to_variants", sql(["fx_responses"], PARSED, VARIANTS, final="select * from variants"))
def q_v4(spark, sf):
    return V.to_variants(V.parse_response(Fixtures(spark, sf).responses))


def _combined(spark, sf):
    fx = Fixtures(spark, sf)
    orig = fx.samples.select("row_id", "text", "label", "grp")
    return V.combine_variants(orig, V.to_variants(V.parse_response(fx.responses)))


@register("U1_combine_variants", sql(["fx_samples", "fx_responses"], PARSED, VARIANTS, final="""
select row_id, text, label, grp, 'original' as origin from fx_samples
union all select row_id, text, label, grp, origin from variants"""))
def q_u1(spark, sf):
    return _combined(spark, sf)


@register("A4_dataset_stats", sql(["fx_samples", "fx_responses"], PARSED, VARIANTS, ("c", """
select 'original' as origin from fx_samples union all select origin from variants"""), final="""
select cast(count_if(origin = 'original') as bigint) as n_original, cast(count_if(origin = 'neutral') as bigint) as n_neutral,
       cast(count_if(origin = 'unrelated') as bigint) as n_unrelated, count(*) as n_total,
       round(count_if(origin = 'neutral') / count_if(origin = 'original'), 6) as neutral_yield,
       round(count_if(origin = 'unrelated') / count_if(origin = 'original'), 6) as unrelated_yield
from c"""))
def q_a4(spark, sf):
    return S.dataset_stats(_combined(spark, sf))


# The variants of the offline generator: CTEs and the final select.
HALVES = (("w", r"""
select row_id, grp, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from fx_samples"""), ("h", """
select row_id, grp, array_to_string(w[1:greatest(1, len(w) // 2)], ' ') as neutral,
       array_to_string(w[greatest(1, len(w) // 2) + 1:], ' ') as unrelated from w"""), """
select row_id, 'neutral' as origin, neutral as text, 'neutral' as label, grp from h where neutral <> ''
union all select row_id, 'unrelated', unrelated, 'unrelated', grp from h where unrelated <> ''""")


@register("V2_generate", sql(["fx_samples"], *HALVES[:-1], final=HALVES[-1]))
def q_v2(spark, sf):
    """Prompts of every sample through the offline generator, parsed back into variants."""
    p = V.build_prompt(Fixtures(spark, sf).samples.select("row_id", "text", "grp")).select("row_id", "grp", "prompt")
    return V.to_variants(V.parse_response(V.generate(p, V.offline_generator_factory)))
