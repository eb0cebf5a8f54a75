"""Exact ranks within keys without one task for a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of the hash range into which every key is dealt. The table of
#: counts has at most keys x BUCKETS rows.
BUCKETS = 4096


def hash_bucket(hex_hash: Column) -> Column:
    """The slice (0 to BUCKETS - 1) of a lowercase hex hash: its first three digits."""
    return F.conv(F.substring(hex_hash, 1, 3), 16, 10).cast("int")


def rank_in_key(df: DataFrame, key: str, bucket: str, order: list[str], rank: str, total: str) -> DataFrame:
    """Adds the rank from 0 of each row within its key, and the rows of the key.

    ``bucket`` must grow with ``order``: rows of a smaller bucket come first.
    Rows are ranked in tasks of one (key, bucket); the start of each bucket
    comes from a count, which is aggregated before it is shuffled. Keys must
    not be null. Ties in ``order`` are broken in no set way.
    """
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (df.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("__n"))
              .select(key, bucket,
                      F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                      F.sum("__n").over(Window.partitionBy(key)).alias(total)))
    inside = F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order)) - 1
    return (df.withColumn("__inside", inside).join(starts, [key, bucket])
            .withColumn(rank, F.col("__before") + F.col("__inside")).drop("__before", "__inside"))
