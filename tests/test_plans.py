"""Plan-shape checks: pruning and pushdown reach the scan, bounded sides
are broadcast, alignment needs one exchange over the prediction rows."""

import re

from pyspark.sql import functions as F

from evalspark.operators import compare as C
from evalspark.operators import errors as E
from evalspark.operators import metrics as M
from evalspark.operators import text as T
from evalspark.sources import io as IO
from evalspark.sources.fixtures import Fixtures
from tests.conftest import SF001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pruning_and_pushdown_reach_the_scan(spark):
    df = IO.read_samples(spark, f"{SF001}/documents.parquet", {"row_id": "doc_id", "grp": "source"})
    p = plan(df.where(F.col("grp") == "src1"))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p
    assert "EqualTo(source,src1)" in p


def test_metrics_one_exchange_over_rows(spark):
    p = plan(M.metrics_by_group(Fixtures(spark, SF001).predictions3))
    # one data exchange (cells) plus the two exchanges over cell-sized tables
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 3
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>" in p


def test_alignment_aggregates_once(spark):
    fx = Fixtures(spark, SF001)
    cells = C.paired_cells(C.tag_sides(fx.predictions3, fx.registry))
    p = plan(cells)
    assert "Join" not in p  # the registry is expanded inside the rows
    assert len(re.findall(r"Exchange hashpartitioning\(row_id#\d+", p)) == 1


def test_tfidf_weights_need_neither_join_nor_exchange(spark):
    docs = Fixtures(spark, SF001).table("documents").select(F.col("doc_id").alias("row_id"), "text")
    p = plan(T.tfidf(docs, max_features=1000))
    assert "Join" not in p and "Exchange" not in p and "ArrowEvalPython" in p
    assert not re.search(r"Exchange hashpartitioning\(row_id#\d+L?, term", p)
    assert not re.search(r"Exchange hashpartitioning\(row_id#\d+L?, term", plan(T.term_counts(docs)))


def test_top_failures_window_group_limit(spark):
    p = plan(E.top_failures(Fixtures(spark, SF001).predictions, 50))
    assert "WindowGroupLimit" in p
