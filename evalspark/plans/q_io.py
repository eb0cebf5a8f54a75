"""Registered queries: sources and sinks (S1, S2, S4-S7, S10), as tables that are written below the
shared checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalspark.operators import generate as V
from evalspark.operators import metrics as M
from evalspark.plans.oracle import sql
from evalspark.plans.q_generate import HALVES
from evalspark.plans.q_metrics import M2_SQL
from evalspark.plans.registry import register
from evalspark.session import checkpoint_subdir
from evalspark.sources import io as IO
from evalspark.sources.fixtures import Fixtures
from evalspark.streaming import expand_incremental


def _folder(spark, name: str) -> str:
    return checkpoint_subdir(spark, f"queries/{name}-{uuid.uuid4().hex}")


def _documents(spark, sf):
    return Fixtures(spark, sf).table("documents").select("doc_id", "text", "lang", "source")


def _samples(spark, sf):
    return Fixtures(spark, sf).samples.select("row_id", "text", "label", "grp")


# Fields with quotes, separators, line breaks and blanks at their ends.
_ODD = """' ' || text || chr(10) || '"' || source || '",' || chr(9) || lang || chr(10)"""


@register("S1_read_delimited", f"select doc_id, {_ODD} as text, lang, source from documents")
def q_s1(spark, sf):
    path = _folder(spark, "s1")
    table = _documents(spark, sf).withColumn("text", F.expr(_ODD))
    table.write.options(sep="\t", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                        ignoreTrailingWhiteSpace=False).csv(path)
    return IO.read_delimited(spark, path, "doc_id long, text string, lang string, source string")


@register("S2_read_samples_csv", "select doc_id as id, text as sentence from documents")
def q_s2_csv(spark, sf):
    path = _folder(spark, "s2")
    IO.write_table(_documents(spark, sf), path, fmt="csv")
    return IO.read_samples(spark, path, {"id": "doc_id", "sentence": "text"}, "csv",
                           "doc_id long, text string, lang string, source string")


@register("S4_read_available", sql(["fx_predictions"], final="""
select model, 'C,D' as missing, count(*) as n, cast(count_if(actual_label = predicted_label) as bigint) as n_correct
from fx_predictions where model in ('A', 'B') group by model"""))
def q_s4(spark, sf):
    preds = Fixtures(spark, sf).predictions
    paths = {m: _folder(spark, "s4") for m in "ABCD"}
    for m in "AB":
        IO.write_table(preds.where(F.col("model") == m).drop("model"), paths[m])
    found, missing = IO.read_available(spark, paths)
    return found.groupBy("model").agg(F.lit(",".join(missing)).alias("missing"), F.count(F.lit(1)).alias("n"),
                                      F.count_if(F.col("actual_label") == F.col("predicted_label")).alias("n_correct"))


@register("S5_write_table", "select doc_id, text, lang, source from documents")
def q_s5(spark, sf):
    path = _folder(spark, "s5")
    IO.write_table(_documents(spark, sf), path, partition_by=["source"])
    return spark.read.parquet(path).select("doc_id", "text", "lang", "source")


@register("S6_write_by_label", "select doc_id, text, lang, 'lang=' || lang as folder from documents")
def q_s6(spark, sf):
    path = _folder(spark, "s6")
    IO.write_by_label(_documents(spark, sf), path, "lang")
    folder = F.regexp_extract(F.input_file_name(), "/(lang=[^/]*)/", 1)
    return spark.read.parquet(path).select("doc_id", "text", "lang", folder.alias("folder"))


def _pct(share: str) -> str:
    return f"cast(round(cast(round({share}, 6) * 100 as decimal(18, 4)), 2) as varchar)"


_CLASS = ("k", """
select model, actual_label as a, sum(n) as total, sum(case when actual_label = predicted_label then n else 0 end) as right_n
from m group by all""")


@register("S7_confusion_report", sql(["fx_predictions"], *M2_SQL, _CLASS, ("rows", f"""
select m.model, 1 as section, row_number() over (partition by m.model order by actual_label, predicted_label) as line_no,
       concat('Actual ', actual_label, ', predicted ', predicted_label, ': ', n, ' (',
              {_pct("case when total > 0 then n / total else 0 end")}, '%)') as line
from m join k on k.model = m.model and k.a = m.actual_label
union all
select model, 2, row_number() over (partition by model order by a),
       concat('Class ', a, ': ', total, ' rows, ', right_n, ' correct (', {_pct("right_n / total")}, '%), ', total - right_n, ' errors')
from k where total > 0
union all
select m.model, 3, row_number() over (partition by m.model order by n desc, actual_label, predicted_label),
       concat('Class ', actual_label, ' taken for ', predicted_label, ': ', n, ' (', {_pct("n / total")}, '%)')
from m join k on k.model = m.model and k.a = m.actual_label where actual_label <> predicted_label and n > 0"""),
    final="select model, cast(section as integer) as section, line_no, line from rows"))
def q_s7(spark, sf):
    """The lines as they are read from the written report, one folder a model."""
    lines = IO.confusion_report_lines(M.confusion_cells(Fixtures(spark, sf).predictions))
    path = _folder(spark, "s7")
    IO.write_text_report(lines, path, by=["model", "section"])
    back = spark.read.text(path, wholetext=True).withColumnRenamed("value", "v")
    # folder values that look like numbers are read as numbers
    one = F.posexplode(F.split(F.regexp_replace("v", "\n$", ""), "\n"))
    return back.select(F.col("model").cast("string").alias("model"), F.col("section").cast("int").alias("section"), one) \
               .select("model", "section", (F.col("pos") + 1).cast("long").alias("line_no"), F.col("col").alias("line"))


@register("S10_expand_incremental", sql(["fx_samples"], *HALVES[:-1], final=HALVES[-1]))
def q_s10(spark, sf):
    """The stream is run, stopped and run again after more samples have come; every sample once."""
    source, out, log = (_folder(spark, f"s10-{x}") for x in ("in", "out", "log"))
    samples = _samples(spark, sf)
    for k in (0, 1):
        samples.where(F.pmod(F.xxhash64("row_id"), F.lit(2)) == k).write.mode("append").parquet(source)
        query = expand_incremental(spark, source, out, V.offline_generator_factory, log)
        query.awaitTermination()
    return spark.read.parquet(out)
