"""DuckDB SQL for the fixtures of FIXTURES.md and a small composer.

The oracle strings are independent re-statements of each query in plain
SQL over the pre-registered parquet views; they share nothing with the
Spark code but the fixture definitions.
"""

from __future__ import annotations


def U(s: str) -> str:
    """Hash-uniform U(s) in DuckDB."""
    return f"((('0x' || substr(md5({s}), 1, 8))::BIGINT) / 4294967296.0::DOUBLE)"


FX: dict[str, tuple[tuple[str, ...], str]] = {}


def _fx(name: str, deps: tuple[str, ...], sql: str) -> None:
    FX[name] = (deps, sql)


_fx("fx_models", (), "select 'A' as model, 0.15 as flip union all select 'B', 0.25 union all select 'C', 0.40")
_fx("fx_samples", (), """
select l.doc_id as row_id, d.text,
       case when l.toxic = 1 then 'stereotype' when l.quality = 1 then 'neutral' else 'unrelated' end as label,
       d.source as grp, 'docs' as data_name
from labels l join documents d on l.doc_id = d.doc_id""")
_fx("fx_samples_null", ("fx_samples",), """
select row_id, text, case when row_id % 9 <> 0 then label end as label, grp, data_name from fx_samples""")
_fx("fx_predictions", ("fx_models", "fx_samples"), f"""
select m.model, x.row_id, x.text, x.actual as actual_label,
       case when {U("concat(m.model, ':', cast(x.row_id as varchar(20)))")} < cast(m.flip as double)
            then 1 - x.actual else x.actual end as predicted_label,
       0.5 + 0.5 * {U("concat('p', m.model, ':', cast(x.row_id as varchar(20)))")} as predicted_probability,
       x.grp, x.data_name as dataset_name
from (select *, case when label = 'stereotype' then 1 else 0 end as actual from fx_samples) x cross join fx_models m""")
_fx("fx_predictions3", ("fx_models",), f"""
select m.model, o.o_orderkey as row_id, o.o_orderpriority as grp, o.y as actual_label,
       case when {U("concat(m.model, ':', cast(o.o_orderkey as varchar(20)))")} < cast(m.flip as double)
            then (o.y + 1) % 3 else o.y end as predicted_label
from (select *, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as y from orders) o cross join fx_models m""")
_fx("fx_pairs", (), """
select u.conv_id * 100 + u.turn as row_id, u.text as sent_more, v.text as sent_less,
       case when u.conv_id % 11 = 0 then null when u.conv_id % 2 = 0 then 'stereo' else 'antistereo' end as stereo_antistereo,
       case when u.conv_id % 7 = 0 then null else concat('g', cast(u.conv_id % 5 as varchar(2))) end as bias_type
from conversations u join conversations v on u.conv_id = v.conv_id and v.turn = u.turn + 1""")
_fx("fx_responses", (), """
select doc_id as row_id, source as grp,
       case doc_id % 5
         when 0 then concat('NEUTRE: ', replace(text, chr(10), ' '))
         when 1 then concat('  Neutre: a: b \n SANS_RAPPORT:  ', replace(text, chr(10), ' '))
         when 2 then concat('NEUTRE: first\nNEUTRE: second\nSans rapport: ', replace(text, chr(10), ' '))
         when 3 then concat('no marker ', text) end as response
from documents""")
_fx("fx_token_weights", (), f"""
select doc_id as row_id, k::INTEGER as pos, token,
       2.0 * {U("concat('w:', cast(doc_id as varchar(20)), ':', cast(k as varchar(10)))")} - 1.0 as weight
from (select doc_id, unnest(string_split(text, ' ')) as token, generate_subscripts(string_split(text, ' '), 1) as k
      from documents) x""")
_fx("fx_registry", (), """
select 1 as pair_id, 'A' as model_a, 'B' as model_b, 'A vs B' as name, 'baseline' as category
union all select 2, 'A', 'C', 'A vs C', 'ablation' union all select 3, 'B', 'C', 'B vs C', 'ablation'""")
_fx("fx_scores", ("fx_predictions",), """
select row_id, actual_label,
       [{'label': 'LABEL_0', 'score': 1.0 - s1}, {'label': 'LABEL_1', 'score': s1}] as scores
from (select row_id, actual_label,
             case when predicted_label = 1 then predicted_probability else 1.0 - predicted_probability end as s1
      from fx_predictions where model = 'A')""")


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in FX[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql(fixtures, *ctes: tuple[str, str], final: str) -> str:
    """WITH <fixtures and their deps>, <ctes> <final select>."""
    parts = [f"{n} as ({FX[n][1]}\n)" for n in _order(list(fixtures))]
    parts += [f"{n} as ({body}\n)" for n, body in ctes]
    head = ("with " + ",\n".join(parts) + "\n") if parts else ""
    return head + final
