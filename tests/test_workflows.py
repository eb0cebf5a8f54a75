from pyspark.sql import functions as F

from evalspark.plans import workflows as W
from evalspark.operators import generate as V
from tests.conftest import SF001


def test_evaluate_reports(spark):
    from evalspark.sources.fixtures import Fixtures
    out = W.evaluate(Fixtures(spark, SF001).predictions)
    assert out["classification_report"].where("row_name = 'accuracy'").count() == 3
    assert out["metrics_by_group"].count() > 0 and out["group_dispersion"].count() == 3


def test_build_dataset(spark, tmpdir_fresh):
    pairs = spark.createDataFrame([(1, "a b c d", "x y", "stereo", "g1"), (2, "p q", "r s t u", None, "g2"),
                                   (3, "m n", "o", "antistereo", None)],
                                  "row_id long, sent_more string, sent_less string, stereo_antistereo string, bias_type string")
    ds = W.build_dataset(pairs, V.offline_generator_factory, out_dir=tmpdir_fresh + "/ds")
    c = {r["origin"]: r["count"] for r in ds.groupBy("origin").count().collect()}
    assert c == {"original": 2, "neutral": 2, "unrelated": 2}
    assert spark.read.parquet(tmpdir_fresh + "/ds").count() == 6
