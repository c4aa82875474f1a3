"""Connected components of a graph of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.session import checkpoint


def _least(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with m, the least of u and all its v; sums per task before the shuffle."""
    least = links.groupBy("u").agg(F.min("v").alias("__v"))
    return links.join(least, "u").select("u", "v", F.least("u", "__v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    out = _least(down).select(F.explode(pairs).alias("p")).select("p.u", "p.v")
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v) that is not its component's least node.

    The number of rounds grows with the logarithm of the longest path. Each round is written to
    the shared folder; only a count and a checksum come to the driver.
    """
    now = checkpoint(links.where("u <> v").select("u", "v").distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        now = checkpoint(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
