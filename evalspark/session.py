"""Session helpers for tests, the bench and the checker.

Library functions never create a session; they take DataFrames. These
helpers only build a local session with the settings the small-scale runs
need and resolve the shared checkpoint folder from the session config.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session settings used for local runs. On a cluster these come from the
# cluster's own configuration; nothing here is required by the operators.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", app: str = "evalspark", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The session's setting always wins, then a folder given to
    ``setCheckpointDir``. Only a local master (tests) gets a fresh temporary
    folder; elsewhere its lack is an error, as executors share no temporary
    folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not is_local_master(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="evalspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def is_local_master(master: str) -> bool:
    """Whether driver and executors are one process: local, local[...]; not local-cluster[...]."""
    return master == "local" or master.startswith("local[")


def checkpoint_subdir(spark: SparkSession, name: str) -> str:
    """A folder below the shared checkpoint dir (stream checkpoints, staged tables)."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def reliable_checkpoint(df):
    """Eager, reliable checkpoint into the shared checkpoint folder: the
    result is written out and its lineage cut, so a lost executor does not
    recompute the upstream plan. (Never a local checkpoint.)"""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows that Python code of a user works on at once: at most this many, and no more once they have this many bytes.
PART_ROWS, PART_BYTES = 256, 1 << 20


def small_parts(batch):
    """A record batch in slices of bounded size, so that a worker never holds a whole batch as Python objects."""
    lo = 0
    while lo < batch.num_rows:
        n = min(PART_ROWS, batch.num_rows - lo)
        while n > 1 and batch.slice(lo, n).nbytes > PART_BYTES:
            n = (n + 1) // 2
        yield batch.slice(lo, n)
        lo += n
