import pytest

from evalspark.session import ensure_checkpoint_dir, is_local_master, reliable_checkpoint


def test_checkpoint_dir_comes_from_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert ensure_checkpoint_dir(spark) == configured
    df = reliable_checkpoint(spark.range(10))
    assert df.count() == 10
    assert "LogicalRDD" in df._jdf.queryExecution().optimizedPlan().toString()


def test_no_silent_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
    assert not is_local_master("local-cluster[3,2,1024]") and not is_local_master("yarn")
    assert is_local_master("local") and is_local_master("local[*]") and is_local_master("local[4,2]")
