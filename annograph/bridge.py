"""Annotation tables derived from the star-schema test tables, with matching DuckDB definitions in `oracles.py`.

Only whole tables are read. Values come from integer arithmetic so that both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annograph.plans.skew import rank_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per array element of every sample (an order), with its array position."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate",
        "l_discount", "l_tax",
    )
    order = ["l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"]
    ranked = rank_rows(lines, ["sample_id"], order, "n", check=lines.select("sample_id"))
    return ranked.withColumn("pos", F.col("n") - 1)


def points_raw(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = elements(spark, sf_dir) if rows is None else rows
    return rows.select(
        "sample_id", "pos", F.lit(True).alias("is_object"), F.col("l_linenumber").alias("id"),
        ((F.col("l_partkey") * 37) % 256).cast("double").alias("x"),
        ((F.col("l_suppkey") * 53) % 256).cast("double").alias("y"),
        (1 - F.col("l_discount")).alias("score"), F.lit("manual").alias("source"),
    )


def edges_raw(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = elements(spark, sf_dir) if rows is None else rows
    return rows.select(
        "sample_id", "pos", F.lit(True).alias("is_object"), F.lit(None).cast("string").alias("edge_id"),
        F.col("l_linenumber").alias("src"), (F.col("l_partkey") % 9).cast("int").alias("dst"), F.lit(1).alias("label"),
        F.lit("manual").alias("source"),
    )


def edges_predicted(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = elements(spark, sf_dir) if rows is None else rows
    return rows.select(
        "sample_id", "pos", F.col("l_linenumber").alias("src"), (F.col("l_suppkey") % 8).cast("int").alias("dst"),
        (1 - F.col("l_tax")).alias("score"),
    )
