"""Radix selection against ``percentile`` and against sorted values."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from evalspark.operators import quantiles as Q
from evalspark.operators import stats as S
from tests.test_plans import plan

AT = (0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0)
EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, -1.0, 1.0000000000000002,
         0.9999999999999999, 2.0, 1e308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), -float("inf"), math.pi]


def test_ordered_bits_are_exact(spark):
    rng = random.Random(1)
    xs = EDGES + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(4000)] + [2.0 ** e for e in range(-1074, 1024)]
    xs += [math.nextafter(2.0 ** e, 0.0) for e in range(-1000, 1024)]
    xs = [x for x in xs if not math.isnan(x)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", Q.ordered_bits(F.col("x")).alias("k"))
    for x, k, back in df.select("x", "k", Q.from_ordered_bits(F.col("k"))).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert k == (-bits if x < 0 else bits), x
        assert back == x, x


def test_nan_comes_last(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    r = Q.order_statistics(df, "x", lambda n: F.sequence(F.lit(0).cast("long"), n - 1)).orderBy("rank").collect()
    assert [r[0]["value"], r[1]["value"]] == [1.0, float("inf")] and math.isnan(r[2]["value"])


def _random(spark):
    rng = random.Random(7)
    rows = [("hot", rng.gauss(0, 1) * 10 ** rng.randint(-8, 8)) for _ in range(6000)]
    rows += [("ties", float(rng.randint(0, 3))) for _ in range(2000)] + [("near", 1 + rng.random() * 1e-9) for _ in range(3000)]
    rows += [(f"g{i}", rng.random()) for i in range(50) for _ in range(rng.randint(1, 4))]
    rows += [(None, rng.random()) for _ in range(100)] + [("nulls", None), ("hot", None)]
    return spark.createDataFrame(rows, "g string, x double").repartition(5)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("broadcast", [True, False])
def test_equal_to_percentile(spark, by, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(Q, "MAX_BROADCAST_BUCKETS", 0)
    df = _random(spark)
    want = df.groupBy(*by).agg(F.count("x").alias("n"), F.percentile("x", F.array(*[F.lit(q) for q in AT])).alias("q"))
    want = {r["g"] if by else None: r for r in want.collect() if r["n"]}
    got = {r["g"] if by else None: r for r in Q.exact_quantiles(df, "x", AT, by).collect()}
    assert got.keys() == want.keys()
    for g, r in got.items():
        assert r["n"] == want[g]["n"]
        assert r["quantiles"] == pytest.approx(want[g]["q"], rel=1e-15, abs=0)


def test_no_buffer_holds_values(spark):
    p = plan(S.five_number(_random(spark), "x", ["g"]))
    assert "percentile" not in p and "collect_list(_x" not in p
    assert "cartesian" not in p.lower() and "NestedLoop" not in p


def test_five_number_of_null_group_names_and_empty_table(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("b", None)], "g string, x double")
    got = {r["g"]: r for r in S.five_number(df, "x", ["g"]).collect()}
    assert set(got) == {None, "a"} and got[None]["median"] == 2.0 and got["a"]["iqr"] == 0.0
    assert S.five_number(df.limit(0), "x", ["g"]).count() == 0
    assert S.five_number(df.limit(0), "x").count() == 0
