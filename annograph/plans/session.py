"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "annograph", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session with the settings the operators are tuned for; cluster sizes come from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", os.environ.get("ANNOGRAPH_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
        )
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a local master may fall back to a temporary one."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="annograph-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` as a parquet table in the shared folder and read it back.

    Cuts the lineage of iterative jobs. Unlike executor-local blocks the table survives the loss of an executor, and
    its size on disk gives later joins a real statistic.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/annograph/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
