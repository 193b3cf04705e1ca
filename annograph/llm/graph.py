"""Connected components over links of rows, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from annograph.llm.common import stored


def _minimum(links: DataFrame) -> DataFrame:
    """Smallest neighbour of each end `u`, itself included. Hub nodes shrink to one row before the shuffle."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """`node`, `label` (smallest node of its component) for every node of the links `u`, `v`.

    Alternates two steps until the links stand still: hang all larger neighbours below the smallest one, then all
    smaller ones. Rounds grow with the logarithm of the longest chain. Each round is a table in the shared folder.
    """
    current = stored(links.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "links")
    mark = _fingerprint(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = both.join(_minimum(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = larger.where("u != v").distinct()
        below = larger.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = _minimum(below)
        smaller = below.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))
        )
        current = stored(smaller.where("u != v").distinct(), "links")
        now = _fingerprint(current)
        if now == mark:
            break
        mark = now
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
