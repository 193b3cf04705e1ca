"""Export routing, manifests and counters for the point model and the link model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annograph.functions import documents as D
from annograph.functions.text import base_name, suffix_of

KINDS = ("points", "edges")


def route(kind: str) -> Column:
    """`error` for samples the export must not use, else `ok`."""
    if kind not in KINDS:
        raise ValueError(f"unknown export kind: {kind}")
    bad = (F.col("error_count") > 0) | (F.col("point_count") == 0)
    if kind == "edges":
        bad = bad | (F.col("point_count") <= 1) | (F.col("edge_count") == 0)
    return F.when(bad, "error").otherwise("ok")


def export_manifest(inspected: DataFrame, kind: str, out: str, include_empty: bool = True) -> DataFrame:
    """Where every image and annotation goes.

    `include_empty` has no effect: a sample without points is routed to `error` before the flag could matter.
    """
    folder = out.rstrip("/")
    routed = inspected.where("state <> 'ORPHAN'").withColumn("route", route(kind))
    ok = F.col("route") == "ok"
    image = base_name(F.col("image_path"))
    return routed.select(
        "sample_id", "route", F.col("image_path").alias("image_src"),
        F.concat(F.when(ok, f"{folder}/images/").otherwise(f"{folder}/error/"), image).alias("image_dst"),
        F.col("json_path").alias("json_src"),
        F.when(ok, F.concat(F.lit(f"{folder}/annotations/"), F.col("sample_id").cast("string"), F.lit(".json")))
        .when(F.col("json_path").isNotNull(), F.concat(F.lit(f"{folder}/error/"), base_name(F.col("json_path")))).alias("json_dst"),
    )


def export_counters(manifest: DataFrame) -> DataFrame:
    ok = F.col("route") == "ok"
    return manifest.agg(
        F.count_if(ok).alias("images_exported"), F.count_if(ok).alias("annotations_exported"),
        F.count_if(~ok).alias("samples_routed_to_error"), F.lit(0).cast("long").alias("skipped_empty_annotations"),
    )


def export_documents(docs: DataFrame, manifest: DataFrame, kind: str) -> DataFrame:
    """(sample_id, json_dst, body) of the accepted samples, from normalised documents."""
    accepted = manifest.where("route = 'ok'").select("sample_id", F.col("image_src").alias("_image"), "json_dst")
    body = (
        D.legacy_json(F.col("_image"), F.col("width"), F.col("height"), F.col("points"))
        if kind == "points"
        else D.master_json(F.col("sample_id").cast("string"), base_name(F.col("_image")), F.col("width"), F.col("height"), F.col("points"), F.col("edges"))
    )
    return docs.join(accepted, "sample_id").select("sample_id", "json_dst", body.alias("body"))


def decisions_manifest(items: DataFrame, decisions: DataFrame, keep_dir: str, trash_dir: str) -> DataFrame:
    """Keep / trash decisions on image+label pairs: one row per file to move. Undecided items are kept."""
    joined = items.join(decisions, "sample_id", "left").withColumn("route", F.coalesce("decision", F.lit("keep")))
    target = F.when(F.col("route") == "trash", trash_dir.rstrip("/") + "/").otherwise(keep_dir.rstrip("/") + "/")
    files = F.array_compact(F.array(F.col("image_path"), F.col("label_path")))
    return joined.select("sample_id", "route", F.explode(files).alias("src"), target.alias("folder")).select(
        "sample_id", "route", "src", F.concat("folder", base_name(F.col("src"))).alias("dst"),
        suffix_of(F.col("src")).alias("suffix"),
    )
