"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.staging import staged


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star operation on edges (a > b): every node's neighbours are linked to its smallest one."""
    if larger:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a")
        out = (linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .union(least.select("a", F.col("m").alias("b"))))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Alternates large-star and small-star steps until the edges are stars.
    Each step is two shuffles of the edges; the number of steps grows with
    the logarithm of the number of nodes. No node's neighbours are ever
    gathered: a hub is one key of an aggregate and of a join. Only two
    numbers per round reach the driver.
    """
    x, y = F.col(a), F.col(b)
    now = staged(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = staged(_stars(_stars(now, larger=True), larger=False), "stars")
        last, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
