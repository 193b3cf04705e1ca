"""Annotation documents: listing, parsing and the move to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annograph.functions import documents as D, json_text as J
from annograph.functions.text import base_name, stem_of, suffix_of
from annograph.schemas import RAW_EDGE, SCHEMA_VERSION


def read_annotations(spark: SparkSession, folder: str, case_sensitive: bool = False) -> DataFrame:
    """(path, stem, raw) of the JSON files directly in `folder`. A missing folder is an error."""
    files = (
        spark.read.text(folder, wholetext=True, pathGlobFilter="*.[jJ][sS][oO][nN]" if not case_sensitive else "*.json")
        .select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("raw"))
    )
    return files.select("path", stem_of(F.col("path")).alias("stem"), "raw")


def annotation_files(files: DataFrame, suffix: str = ".json", case_sensitive: bool = False, skip_hidden: bool = False) -> DataFrame:
    """(path, stem) of the annotation files in a listing. Spark's own readers never list names that start with a dot."""
    tail = suffix_of(F.col("path"))
    kept = files.where((tail if case_sensitive else F.lower(tail)) == suffix)
    if skip_hidden:
        kept = kept.where(~base_name(F.col("path")).startswith("."))
    return kept.select("path", stem_of(F.col("path")).alias("stem"))


def read_documents(raw: DataFrame) -> DataFrame:
    """`raw` with its text parsed as `doc` and, of texts too large for one VARIANT, the long arrays as `parts`.

    Of a repeated key the last value counts.
    """
    raw.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = raw.withColumn("doc", J.document(F.col("raw")))
    parted = parsed.withColumn("parts", J.long_parts(F.col("raw"), F.col("doc")))
    return parted.withColumn("doc", F.coalesce("doc", J.document(F.col("parts.head"))))


def _parts() -> tuple[Column, ...]:
    """The parsed document and its points, edges and shapes where they come in parts."""
    return F.col("doc"), *[J.long_array(F.col("parts"), name) for name in J.LONG_ARRAYS]


def parse_annotations(raw: DataFrame) -> DataFrame:
    """Typed documents from (path, stem, raw); both dialects. Unreadable text keeps its row with readable=false.

    Opaque parts (`roi`, `segments`, `metadata`) stay VARIANT with the type guards of the format.
    """
    parsed = read_documents(raw)
    doc, points, edges, shapes = _parts()
    legacy = D.is_legacy(doc)
    from_shapes = D.as_raw_points(D.legacy_points(doc, shapes))
    stated = F.when(legacy, D.field(doc, "$.imagePath", "string")).otherwise(D.field(doc, "$.image_path", "string"))
    return parsed.select(
        F.col("stem").alias("sample_id"), F.col("path").alias("json_path"),
        doc.isNotNull().alias("readable"), (legacy | D.is_object(doc)).alias("is_object"), legacy.alias("legacy"),
        stated.alias("image_path"),
        F.when(legacy, D.positive_int(doc, "$.imageWidth")).otherwise(D.positive_int(doc, "$.image_size.width")).alias("width"),
        F.when(legacy, D.positive_int(doc, "$.imageHeight")).otherwise(D.positive_int(doc, "$.image_size.height")).alias("height"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        D.field(doc, "$.roi", "variant").alias("roi"), D.field(doc, "$.spacing_hint", "double").alias("spacing_hint"),
        F.when(D.array_at(doc, "$.segments").isNotNull(), D.field(doc, "$.segments", "variant"))
        .otherwise(F.parse_json(F.lit("[]"))).alias("segments"),
        F.when(legacy, F.parse_json(F.to_json(D.legacy_metadata())))
        .when(D.is_object(D.field(doc, "$.metadata", "variant")), D.field(doc, "$.metadata", "variant"))
        .otherwise(F.parse_json(F.lit("{}"))).alias("metadata"),
        F.when(legacy, from_shapes).otherwise(D.raw_points(doc, points)).alias("raw_points"),
        F.when(legacy, F.expr(f"cast(array() as array<{RAW_EDGE}>)"))
        .otherwise(D.raw_edges(doc, edges)).alias("raw_edges"),
    )


def to_point_schema(raw: DataFrame) -> DataFrame:
    """Any dialect to points for the link step: a document with a `points` key keeps them, others use strict shapes."""
    parsed = read_documents(raw).where(D.is_object(F.col("doc")))
    doc, points, edges, shapes = _parts()
    current = D.has_key(doc, "points")
    return parsed.select(
        F.coalesce(F.when(current, D.field(doc, "$.sample_id", "string")), F.col("stem")).alias("sample_id"),
        base_name(F.col("path")).alias("json_name"), F.col("path").alias("json_path"), current.alias("current"),
        D.field(doc, "$.image_path", "string").alias("image_path"),
        F.when(current, D.positive_int(doc, "$.image_size.width")).otherwise(D.positive_int(doc, "$.imageWidth")).alias("width"),
        F.when(current, D.positive_int(doc, "$.image_size.height")).otherwise(D.positive_int(doc, "$.imageHeight")).alias("height"),
        F.when(current, D.raw_points(doc, points)).otherwise(D.as_raw_points(D.legacy_points_strict(doc, shapes))).alias("raw_points"),
        F.when(current, D.raw_edges(doc, edges)).alias("raw_edges"),
    )


def usable_sources(raw: DataFrame, source: str = "source") -> DataFrame:
    """Per source folder: does any document hold at least two usable points (either dialect)?"""
    doc, points, _, shapes = _parts()
    points = F.greatest(
        F.coalesce(F.size(F.coalesce(points, D.array_at(doc, "$.points"))), F.lit(0)), F.size(D.legacy_points_strict(doc, shapes))
    )
    return read_documents(raw).groupBy(source).agg(F.max(F.when(D.is_object(doc), points).otherwise(0)).alias("best"))


def choose_source(usable: DataFrame, requested: str, fallback: str, source: str = "source") -> DataFrame:
    """One row: the requested source when it is usable, else a usable fallback, else the requested one."""
    best = lambda name: F.coalesce(F.max(F.when(F.col(source) == name, F.col("best"))), F.lit(0)) >= 2
    return usable.agg(
        F.when(best(requested), F.lit(requested)).when(best(fallback), F.lit(fallback)).otherwise(F.lit(requested)).alias("chosen"),
        (~best(requested) & best(fallback)).alias("fell_back"),
    )


def review_documents(raw: DataFrame) -> DataFrame:
    """Review reading: a list under `points` or `edges` means a current document, all else legacy points, no links."""
    parsed = read_documents(raw).where("doc is not null")
    doc, points, edges, shapes = _parts()
    current = D.array_at(doc, "$.points").isNotNull() | D.array_at(doc, "$.edges").isNotNull()
    legacy = D.is_legacy(doc)
    return parsed.select(
        F.col("stem").alias("sample_id"), current.alias("current"),
        F.when(current & ~legacy, D.raw_points(doc, points)).otherwise(D.as_raw_points(D.legacy_points(doc, shapes))).alias("raw_points"),
        F.when(current & ~legacy, D.raw_edges(doc, edges))
        .otherwise(F.expr(f"cast(array() as array<{RAW_EDGE}>)"))
        .alias("raw_edges"),
    )
