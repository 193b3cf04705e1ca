"""Pairing images with annotations: review lists and prioritised image resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from annograph.functions.text import base_name, stem_of, stripped
from annograph.schemas import IMAGE_SUFFIXES, RESOLVE_SUFFIX_ORDER, TRAINING_SUFFIX_ORDER


def paired(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(annotations, "stem", "inner")


def filter_items(images: DataFrame, labels: DataFrame, require_label: bool = True) -> DataFrame:
    """Review list: labelled images only, or all of them."""
    named = labels.select("stem", F.col("path").alias("label_path"))
    return images.select("stem", F.col("path").alias("image_path")).join(named, "stem", "inner" if require_label else "left")


def folder_items(images: DataFrame, sources: DataFrame) -> DataFrame:
    """All images with their optional source annotation (last path per stem)."""
    last = sources.groupBy("stem").agg(F.max("path").alias("source_path"))
    return images.select("stem", F.col("path").alias("image_path")).join(last, "stem", "left")


def label_counts(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count_if(F.col("label_path").isNotNull()).alias("labelled"), F.count_if(F.col("label_path").isNull()).alias("unlabelled")
    )


def _priority(suffix: Column, order: Sequence[str]) -> Column:
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), suffix)
    return F.when(rank > 0, rank)


def training_pairs(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One image per annotation by suffix order; annotations without an image drop out.

    The minimum per stem is aggregated on the image side first, so the join sees one row per stem.
    """
    ranked = images.withColumn("p", _priority(F.col("suffix"), TRAINING_SUFFIX_ORDER)).where("p is not null")
    best = ranked.groupBy("stem").agg(F.min_by("path", "p").alias("image_path"))
    return annotations.select("stem", F.col("path").alias("json_path")).join(best, "stem")


def resolve_images(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Image of each annotation: base name of its image path first, then stem plus suffix in order; `error` if none.

    `annotations`: path, stem, image_path. `images`: path with unique names inside one folder.
    """
    files = images.select(base_name(F.col("path")).alias("name"), F.col("path").alias("file"))
    by_stem = images.withColumn("p", _priority(F.col("suffix"), RESOLVE_SUFFIX_ORDER)).where("p is not null")
    by_stem = by_stem.groupBy("stem").agg(F.min_by("path", "p").alias("second"))
    stated = annotations.withColumn("name", base_name(stripped(F.coalesce("image_path", F.lit("")))))
    first = files.groupBy("name").agg(F.min("file").alias("first"))
    j = stated.join(first, "name", "left").join(by_stem, "stem", "left")
    found = F.coalesce("first", "second")
    return j.select(F.col("path").alias("json_path"), found.alias("image_path"), F.when(found.isNull(), "IMAGE_NOT_FOUND").alias("error"))


def resolve_images_for_prediction(annotations: DataFrame, images: DataFrame, image_dir: str) -> DataFrame:
    """Image path of each annotation: stated path, beside the annotation, image folder plus stem, annotation stem; else the
    stated text. Suffixes inside one step follow the listed order."""
    known = images.select("path").distinct()
    folder = F.regexp_replace(F.col("path"), r"[^/]*$", "")
    raw = stripped(F.coalesce("image_path", F.lit("")))
    listed = lambda prefix: [F.concat(prefix, F.lit(s)) for s in IMAGE_SUFFIXES]
    candidates = F.array(
        F.when(raw != "", raw), F.when(raw != "", F.concat(folder, raw)),
        *listed(F.concat(F.lit(image_dir.rstrip("/") + "/"), "stem")), *listed(F.concat(folder, stem_of(F.col("path")))),
    )
    each = annotations.select(F.col("path").alias("json_path"), raw.alias("raw"), F.posexplode(candidates).alias("p", "candidate")).where("candidate is not null")
    hits = each.join(known.withColumnRenamed("path", "candidate"), "candidate", "left_semi")
    best = hits.groupBy("json_path").agg(F.min_by("candidate", "p").alias("found"))
    return annotations.select(F.col("path").alias("json_path"), raw.alias("raw")).join(best, "json_path", "left").select(
        "json_path", F.coalesce("found", "raw").alias("image_path")
    )
