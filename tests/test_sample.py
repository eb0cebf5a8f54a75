import re

import pytest
from pyspark.sql import functions as F

from evalspark.operators import sample as SA


def _labelled(spark, n=5029, pos=1677):
    return spark.range(n).select(F.col("id").alias("row_id"),
                                 F.when(F.col("id") < pos, "stereotype").otherwise("other").alias("label"))


def test_published_split_sizes(spark):
    s = SA.split_stratified(_labelled(spark), 0.2)
    c = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert c[("other", "test")] == 671 and c[("stereotype", "test")] == 335
    assert sum(c.values()) == 5029


def test_split_disjoint_complete_and_partition_invariant(spark):
    df = _labelled(spark, 3000, 700)
    a = SA.split_stratified(df, 0.25)
    b = SA.split_stratified(df.repartition(13), 0.25)
    ra = {r["row_id"]: r["split"] for r in a.collect()}
    rb = {r["row_id"]: r["split"] for r in b.collect()}
    assert len(ra) == 3000 and ra == rb


def test_split_matches_plain_window(spark):
    from pyspark.sql import Window
    df = _labelled(spark, 2000, 450)
    s = SA.split_stratified(df, 0.2).where("split = 'test'").select("row_id")
    h = F.md5(F.concat(F.lit("42:"), F.col("row_id").cast("string")))
    rn = F.row_number().over(Window.partitionBy("label").orderBy(h, "row_id"))
    quota = {"stereotype": 90, "other": 310}
    w = df.withColumn("rn", rn).where(
        (F.col("label") == "stereotype") & (F.col("rn") <= quota["stereotype"]) |
        (F.col("label") == "other") & (F.col("rn") <= quota["other"])).select("row_id")
    assert sorted(r[0] for r in s.collect()) == sorted(r[0] for r in w.collect())


def test_downsample_and_equal_per_class(spark):
    df = _labelled(spark, 1000, 100)
    d = SA.downsample_stratified(df, 50)
    c = {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}
    assert c == {"stereotype": 5, "other": 45}
    assert SA.downsample_stratified(df, 5000).count() == 1000
    e = SA.sample_equal_per_class(df, 30)
    assert {r["label"]: r["count"] for r in e.groupBy("label").count().collect()} == {"stereotype": 15, "other": 15}


def test_window_group_limit_planned(spark):
    df = _labelled(spark, 1000, 100)
    plan = SA.sample_equal_per_class(df, 30)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_quotas_beyond_the_range_of_long_products(spark):
    billions = spark.createDataFrame([("a", 0, 4_000_000_000), ("b", 0, 6_000_000_001), (None, 0, 7)],
                                     "label string, _bk int, _cnt long")
    q = SA.stratum_quotas(billions, "label", F.ceil(F.lit(0.2) * F.col("_N")).cast("long"))
    got = {r["label"]: r["_quota"] for r in q.collect()}
    assert got == {"a": 800_000_000, "b": 1_200_000_001, None: 1}


def test_null_strata_are_a_stratum(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") % 4 != 0, F.concat(
        F.lit("l"), (F.col("id") % 2).cast("string"))).alias("label"))
    s = SA.split_stratified(df, 0.2)
    c = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert sum(n for (_, part), n in c.items() if part == "test") == 20 and sum(c.values()) == 100
    assert c[None, "test"] == 5
    assert SA.downsample_stratified(df, 1000).count() == 100
    e = SA.sample_equal_per_class(df, 30)
    assert {r["label"]: r["count"] for r in e.groupBy("label").count().collect()} == {"l0": 15, "l1": 15}


def test_split_shuffles_no_input_rows_by_label(spark, tmp_path):
    path = str(tmp_path / "t")
    _labelled(spark, 3000, 700).withColumn("text", F.lit("t")).write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plan = SA.split_stratified(spark.read.parquet(path), 0.2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    above = _exchanges_above_scans_of(plan, "text")
    assert len(above) == 1 and "_bk" in above[0]  # the rows of the cut buckets


def _exchanges_above_scans_of(plan, column):
    """Exchange lines that a scan reading the column goes through."""
    lines = plan.splitlines()
    depth = [re.search(r"[A-Za-z*]", x).start() if re.search(r"[A-Za-z*]", x) else 0 for x in lines]
    out = []
    for k, x in enumerate(lines):
        if "FileScan" in x and f"{column}#" in x:
            at = k
            for j in range(k - 1, -1, -1):
                if depth[j] < depth[at]:
                    at = j
                    if "Exchange" in lines[j]:
                        out.append(lines[j])
    return out
