"""The steps chained over folders: one inspection serves the report and both exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annograph.operators import export, normalize, validate
from annograph.plans.session import materialize
from annograph.sinks import writers
from annograph.sources import annotations, images


def inspect_folders(spark: SparkSession, image_dir: str, annotation_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inspected samples, normalised documents, issues of all samples); the first two are written once."""
    sizes = validate.last_per_stem(images.image_sizes(spark, image_dir).where(F.lower("suffix").isin(*images.IMAGE_SUFFIXES)))
    facts = sizes.select(F.col("stem").alias("sample_id"), F.col("path").alias("image_path"), F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    raw = validate.last_per_stem(annotations.read_annotations(spark, annotation_dir))
    named = annotations.parse_annotations(raw).join(facts.select("sample_id", "image_path"), "sample_id", "left").select(
        "sample_id", "json_path", "readable", "is_object", "width", "height",
        F.coalesce(facts["image_path"], F.concat("sample_id", F.lit(".png"))).alias("image_path"), "raw_points", "raw_edges",
    )
    docs = materialize(normalize.normalize_rows(named).drop("raw_points", "raw_edges"), "normalized")
    stats, issues = validate.document_stats(docs), docs.select("sample_id", F.inline("issues"))
    return materialize(validate.inspect(facts, stats), "inspected"), docs, issues


def run_flow(spark: SparkSession, image_dir: str, annotation_dir: str, out: str, brief: bool = False) -> dict[str, DataFrame]:
    """Report and both exports under a new version path; returns the small result tables by name.

    Files are named in the manifests; `writers.copy_files` copies them where that is wanted.
    """
    inspected, docs, issues = inspect_folders(spark, image_dir, annotation_dir)
    root = writers.versioned_path(out)
    result = validate.ValidationResult(validate.summarize(inspected), inspected, validate.histogram(inspected), validate.findings(inspected))
    writers.write_report(result, f"{root}/report", brief)
    tables = {"summary": result.summary, "digest": validate.digest_lines(inspected, issues)}
    for kind in export.KINDS:
        manifest = materialize(export.export_manifest(inspected, kind, f"{root}/{kind}"), "manifest")
        tables[kind] = writers.write_export(manifest, export.export_documents(docs, manifest, kind), f"{root}/{kind}_tables")
    return tables
