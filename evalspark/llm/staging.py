"""Tables written to the shared folder between the steps of one job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from evalspark.session import checkpoint_subdir


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below the session's spark.checkpoint.dir and reads it back: a later
    step can lose executors without computing it again, and all its readers see one result."""
    spark = df.sparkSession
    path = checkpoint_subdir(spark, f"staged/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
