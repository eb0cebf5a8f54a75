"""Operator 8, sharding: proportional stratified interleaving.

Rows of each source are put in a seeded random order; the row of rank r of a
source with n rows gets the fractional rank (2r + 1) / 2n. In the order of
that fraction every stretch holds the sources in their proportions, and the
order is cut into shards whose row counts differ by one at most (law
``rows``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.ranking import BUCKETS, hash_bucket, rank_in_key


def shard_rows(df: DataFrame, key: str, source: str, n_shards: int, seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in the shard) to every row.

    Order within a source: md5 of "seed:key". Null sources form a source of
    their own, null keys hash as "seed:". Rows with one key are kept, each
    with a slot of its own; which of two rows with equal keys comes first is
    open. An empty table gives an empty result. Input columns named shard or
    slot are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))
    rows = (df.drop("shard", "slot")
            .withColumn("__src", F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")))
            .withColumn("__h", hashed).withColumn("__b", hash_bucket(F.col("__h"))))
    # one source: __b, __h order; all sources: fraction, then __h
    ranked = rank_in_key(rows, "__src", "__b", ["__h", *ties], "__r", "__n").drop("__b")
    placed = (ranked.withColumn("__slice", F.expr(f"cast((2 * __r + 1) * {BUCKETS} div (2 * __n) as int)"))
              .withColumn("__frac", (2 * F.col("__r") + 1) / (2 * F.col("__n"))))
    # rows before slice k, from the sizes of the sources alone: ranks r with (2r + 1) * BUCKETS < 2 n k
    k = F.col("__slice")
    below = F.ceil((2 * F.col("__size") * k - BUCKETS) / (2 * BUCKETS))
    sizes = rows.groupBy("__src").agg(F.count(F.lit(1)).alias("__size"))
    starts = (sizes.select("__size", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("__slice"))
              .groupBy("__slice").agg(F.sum(F.greatest(below, F.lit(0))).alias("__start"),
                                      F.sum("__size").alias("__all")))
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy("__frac", "__h", *ties)) - 1
    position = F.col("__start") + F.col("__inside")
    # shard s holds positions ceil(s * all / shards) up to the next start
    shard = F.expr(f"(__pos * {n_shards}L) div __all")
    first = F.expr(f"(shard * __all + {n_shards - 1}L) div {n_shards}L")
    # BUCKETS rows at most: small enough to send to every task
    return (placed.withColumn("__inside", inside).join(F.broadcast(starts), "__slice")
            .withColumn("__pos", position).withColumn("shard", shard.cast("int"))
            .withColumn("slot", F.col("__pos") - first)
            .drop("__slice", "__frac", "__h", "__src", "__r", "__n", "__inside", "__start", "__all", "__pos"))


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard.

    The texts are measured where they are scanned and not shuffled. A null
    text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return (shard_rows(slim, "doc_id", "source", n_shards, seed, ("text_crc32", "size"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "source"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes rows with shard and slot as one folder per shard, in slot order within each file."""
    (sharded.repartition("shard").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
