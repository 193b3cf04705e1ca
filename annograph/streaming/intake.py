"""Incremental intake: each new file is checked once; repeated content is recognised by its hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from annograph.functions.text import stem_of
from annograph.operators.normalize import normalize_rows
from annograph.operators.validate import document_stats
from annograph.sources.annotations import parse_annotations
from annograph.sources.images import _decoded


#: Spark's file stream passes over files that are a week older than the newest one; copies often keep their old times.
ANY_AGE = "36500d"


def annotation_stream(spark: SparkSession, folder: str, max_files: int = 10_000) -> DataFrame:
    """New annotation files as (path, stem, raw)."""
    files = (
        spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", max_files).option("maxFileAge", ANY_AGE).load(folder)
    )
    named = files.select(_decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("raw"))
    return named.withColumn("stem", stem_of(F.col("path")))


def checked(raw: DataFrame) -> DataFrame:
    """Counts per document and the route its annotation alone decides. No state, no shuffle."""
    stats = document_stats(normalize_rows(parse_annotations(raw)))
    bad = ~F.col("readable") | ~F.col("is_object") | (F.col("issue_count") > 0) | (F.col("point_count") == 0)
    return stats.withColumn("route", F.when(bad, "error").otherwise("ok"))


def run_intake(spark: SparkSession, folder: str, out: str, checkpoint: str, on_batch: Callable | None = None):
    """Check everything that is new, then stop. Started again with the same checkpoint it sees only newer files.

    A batch that runs twice after a failure overwrites its own folder, so the output holds every file once.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if on_batch is not None:
            on_batch(batch, batch_id)

    query = (
        checked(annotation_stream(spark, folder)).writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


SEEN = "md5 string, path string, modificationTime timestamp, length long"


def run_distinct_content(files: DataFrame, out: str, checkpoint: str):
    """Write the first file of every content hash under `out`, whatever the files' times, then stop.

    `files`: streaming binaryFile rows. The output itself is the memory: a batch leaves out the hashes that earlier
    batches wrote. It reads those only, so a batch that runs twice after a failure overwrites its folder with the same rows.
    """
    spark = files.sparkSession
    spark.createDataFrame([], SEEN).write.mode("ignore").parquet(f"{out}/batch=-1")

    def save(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        hashed = batch.select(F.md5("content").alias("md5"), F.struct("modificationTime", "path", "length").alias("f"))
        first = hashed.groupBy("md5").agg(F.min("f").alias("f")).select("md5", "f.path", "f.modificationTime", "f.length")
        known = session.read.schema(f"{SEEN}, batch long").parquet(out).where(F.col("batch") < batch_id).select("md5")
        first.join(known, "md5", "left_anti").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def image_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFileAge", ANY_AGE).load(folder)
