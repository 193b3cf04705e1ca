"""Prediction against truth: edge classes, per-sample and corpus metrics, logits, edge geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annograph.operators.normalize import edge_set, proper_links
from annograph.schemas import METRIC_FIELDS


def classify_edges(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(sample_id, u, v, class) with class TP, FP or FN; both sides become distinct undirected links first."""
    side = lambda links, p: proper_links(links).withColumn("p", F.lit(p))
    # a link without a sample equals none of the other side
    alone = F.when(F.col("sample_id").isNull(), F.col("p")).alias("alone")
    both = side(predicted, True).unionByName(side(truth, False)).groupBy("sample_id", "u", "v", alone)
    label = F.when(F.col("p") & F.col("t"), "TP").when(F.col("p"), "FP").otherwise("FN")
    return both.agg(F.max("p").alias("p"), F.max(~F.col("p")).alias("t")).select("sample_id", "u", "v", label.alias("class"))


def edge_classes_by_sets(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """The same classes through set operators."""
    p, t = edge_set(predicted), edge_set(truth)
    named = lambda df, c: df.withColumn("class", F.lit(c))
    return named(p.intersect(t), "TP").unionByName(named(p.subtract(t), "FP")).unionByName(named(t.subtract(p), "FN"))


def ratios(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1 with guarded denominators."""
    precision = tp / F.greatest(tp + fp, F.lit(1))
    recall = tp / F.greatest(tp + fn, F.lit(1))
    return [
        precision.alias("precision"), recall.alias("recall"),
        (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-8))).alias("f1"),
    ]


def edge_metrics(predicted: DataFrame, truth: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Per-sample metrics. `samples` (sample_id[, json_name]) keeps samples without any link on either side."""
    classes = classify_edges(predicted, truth)
    count = lambda c: F.count_if(F.col("class") == c)
    counted = classes.groupBy("sample_id").agg(count("TP").alias("tp"), count("FP").alias("fp"), count("FN").alias("fn"))
    if samples is not None:
        counted = samples.join(counted, "sample_id", "left").fillna(0, ["tp", "fp", "fn"])
    if "json_name" not in counted.columns:
        counted = counted.withColumn("json_name", F.concat(F.col("sample_id").cast("string"), F.lit(".json")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(
        "sample_id", "json_name", (tp + fn).alias("gt_edges"), (tp + fp).alias("pred_edges"), "tp", "fp", "fn", *ratios(tp, fp, fn)
    ).select(*METRIC_FIELDS)


def corpus_metrics(metrics: DataFrame) -> DataFrame:
    """Micro-averaged metrics: sums first, ratios after."""
    total = metrics.agg(F.count(F.lit(1)).alias("evaluated_samples"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return total.select("*", *ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def run_counters(documents: DataFrame, metrics: DataFrame) -> DataFrame:
    """Run summary. `documents`: sample_id, readable, point_count per input file."""
    readable = F.col("readable")
    head = documents.agg(
        F.count(F.lit(1)).alias("num_json"), F.count_if(readable & (F.col("point_count") >= 2)).alias("saved_annotations"),
        F.count_if(readable & (F.col("point_count") < 2)).alias("skipped_empty_points"), F.count_if(~readable).alias("errors"),
    )
    tail = corpus_metrics(metrics)
    return head.withColumn("one", F.lit(1)).join(F.broadcast(tail.withColumn("one", F.lit(1))), "one").drop("one")


def binary_metrics(logits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, f1 of (logit, label) rows after a sigmoid and a threshold."""
    hit = (1 / (1 + F.exp(-F.col("logit")))) >= threshold
    positive = F.col("label") == 1
    c = logits.agg(
        F.count_if(hit & positive).alias("tp"), F.count_if(hit & ~positive).alias("fp"), F.count_if(~hit & positive).alias("fn"),
        F.avg((hit == positive).cast("double")).alias("accuracy"),
    )
    return c.select("accuracy", *ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def edge_geometry(classes: DataFrame, points: DataFrame) -> DataFrame:
    """Coordinates of both ends and the class of each link; links with a missing end are left out."""
    end = lambda s, n: points.select("sample_id", F.col("id").alias(s), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    return classes.join(end("u", 1), ["sample_id", "u"]).join(end("v", 2), ["sample_id", "v"]).select(
        "sample_id", "u", "v", "class", "x1", "y1", "x2", "y2"
    )
