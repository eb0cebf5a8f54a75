import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from evalspark.session import ensure_checkpoint_dir

    s = (SparkSession.builder.master("local[*]").appName("evalspark-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="evalspark-test-")


def preds_from_cells(spark, cells, model="m", grp=None):
    """Expand {(actual, predicted): n} into prediction rows."""
    rows = []
    rid = 0
    for (a, p), n in cells.items():
        for _ in range(n):
            rows.append((model, rid, f"t{rid}", a, p, 0.9, grp, "d"))
            rid += 1
    return spark.createDataFrame(rows, "model string, row_id long, text string, actual_label int, "
                                       "predicted_label int, predicted_probability double, grp string, "
                                       "dataset_name string")
