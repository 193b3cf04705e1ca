"""Writers: documents, reports, metrics and file copies driven by manifests."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from annograph.operators.evaluate import corpus_metrics
from annograph.operators.export import export_counters
from annograph.operators.validate import ValidationResult
from annograph.schemas import METRIC_FIELDS
from annograph.sinks import files


def write_annotations(documents: DataFrame, out: str, layout: str = "dataset", name: str = "json_dst", body: str = "body") -> None:
    """`dataset`: one parquet dataset of (name, body). `files`: one UTF-8 file per row, all of them or none."""
    if layout == "dataset":
        documents.select(name, body).write.mode("errorifexists").parquet(out)
    elif layout == "files":
        files.write_files(documents, out, name, body, indent=2)
    else:
        raise ValueError(f"unknown layout: {layout}")


def copy_files(manifest: DataFrame, src: str = "src", dst: str = "dst", overwrite: bool = False) -> None:
    """Copy files named by a manifest, all or none. Existing targets are skipped unless `overwrite`.

    A move is this copy followed by the caller's own removal of `src`; nothing is deleted here.
    """
    files.copy(manifest, src, dst, overwrite)


def write_export(manifest: DataFrame, documents: DataFrame, out: str) -> DataFrame:
    """Routed manifest (partitioned by route) and accepted documents; returns the counters."""
    manifest.write.partitionBy("route").mode("errorifexists").parquet(f"{out}/manifest")
    write_annotations(documents, f"{out}/documents")
    return export_counters(manifest)


def write_metrics_csv(metrics: DataFrame, out: str) -> bool:
    """Metrics in fixed column order with a header; nothing is written when there are no rows.

    Plain UTF-8 without a byte-order mark, as Spark writes it.
    """
    if not metrics.limit(1).count():
        return False
    metrics.select(*METRIC_FIELDS).write.mode("errorifexists").option("header", True).csv(out)
    return True


def write_metrics_summary(metrics: DataFrame, out: str) -> bool:
    """Micro-averaged metrics as one JSON row, only when a sample was evaluated."""
    summary = corpus_metrics(metrics)
    if not metrics.limit(1).count():
        return False
    summary.write.mode("errorifexists").json(out)
    return True


def write_report(result: ValidationResult, out: str, brief: bool = False) -> None:
    """Validation report tables; the brief form leaves out the sample rows."""
    result.summary.write.mode("errorifexists").json(f"{out}/summary")
    result.histogram.write.mode("errorifexists").json(f"{out}/histogram")
    result.findings.write.partitionBy("category").mode("errorifexists").parquet(f"{out}/findings")
    if not brief:
        result.sample_report.write.mode("errorifexists").parquet(f"{out}/samples")


def versioned_path(root: str) -> str:
    """A new dataset path per run; earlier versions stay as they are."""
    return f"{root.rstrip('/')}/version={time.strftime('%Y%m%d-%H%M%S', time.gmtime())}-{time.time_ns() % 1_000_000:06d}"


def write_versioned(df: DataFrame, root: str) -> str:
    path = versioned_path(root)
    df.withColumn("written_at", F.current_timestamp()).write.mode("errorifexists").parquet(path)
    return path
