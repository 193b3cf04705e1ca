"""Validation: pairing by stem, per-sample inspection, counters, histograms and findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annograph.operators.normalize import Normalized, issue, let
from annograph.schemas import FINDING_ORDER, ISSUE_TEXT

HISTOGRAM_CAP = 20
OVERFLOW_SHOWN = 10
MAX_DEGREE = 2


@dataclass
class ValidationResult:
    summary: DataFrame
    sample_report: DataFrame
    histogram: DataFrame
    findings: DataFrame


def last_per_stem(files: DataFrame, key: str = "stem", path: str = "path") -> DataFrame:
    """One file per stem; the last path in sort order wins."""
    rest = [c for c in files.columns if c != key]
    return files.groupBy(key).agg(F.max_by(F.struct(*rest), path).alias("f")).select(key, "f.*")


def missing_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(annotations.select("sample_id"), "sample_id", "left_anti")


def orphan_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return annotations.join(images.select("sample_id"), "sample_id", "left_anti")


def document_stats(docs: DataFrame) -> DataFrame:
    """Counts and degree overflow of normalised documents, one row per sample, no shuffle."""
    ends = F.array_sort(F.concat(F.transform("edges", lambda e: e["src"]), F.transform("edges", lambda e: e["dst"])))
    over = let(ends, lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + MAX_DEGREE) == x)))
    keep = [c for c in ("json_path", "readable", "is_object", "width", "height") if c in docs.columns]
    return docs.select(
        "sample_id", *keep, F.size("points").alias("point_count"), F.size("edges").alias("edge_count"),
        F.size("issues").alias("issue_count"),
        let(over, lambda o: F.struct(F.size(o).alias("n"), F.array_join(F.slice(o, 1, OVERFLOW_SHOWN), ", ").alias("shown"))).alias("over"),
    ).select("*", F.col("over.n").alias("overflow_count"), F.col("over.shown").alias("overflow_shown")).drop("over")


def degrees(edges: DataFrame) -> DataFrame:
    """(sample_id, id, degree) over both ends of every link."""
    ends = edges.select("sample_id", F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("sample_id", "id").agg(F.count(F.lit(1)).alias("degree"))


ID_BUCKET_BITS = 16  # consecutive ids that are searched together


def overflow_points(edges: DataFrame) -> DataFrame:
    """Per sample: number of points above the degree limit and the first ten ids, as text.

    The ten smallest are picked per id bucket first, so a sample with very many of them is never gathered.
    """
    over = degrees(edges).where(F.col("degree") > MAX_DEGREE).withColumn("b", F.shiftright("id", ID_BUCKET_BITS))
    counts = over.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("overflow_count"))
    near = over.withColumn("r", F.row_number().over(W.partitionBy("sample_id", "b").orderBy("id"))).where(F.col("r") <= OVERFLOW_SHOWN)
    near = near.withColumn("r", F.row_number().over(W.partitionBy("sample_id").orderBy("id"))).where(F.col("r") <= OVERFLOW_SHOWN)
    shown = near.groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("overflow_shown"))
    return counts.join(shown, "sample_id")


def table_stats(norm: Normalized, samples: DataFrame) -> DataFrame:
    """`document_stats` from element tables; `samples` names every sample to report."""
    size = lambda t, name: t.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias(name))
    out = samples
    for part in (size(norm.points, "point_count"), size(norm.edges, "edge_count"), size(norm.issues, "issue_count"), overflow_points(norm.edges)):
        out = out.join(part, "sample_id", "left")
    counts = ("point_count", "edge_count", "issue_count", "overflow_count")
    return out.fillna(0, list(counts)).fillna("", ["overflow_shown"])


def inspect(images: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per stem of either side, with its state and counts.

    `images`: sample_id, image_path, image_width, image_height (null size = unreadable). `stats`: one row per annotation
    from `document_stats` or `table_stats` with json_path, readable, is_object, width, height.
    """
    left = images.withColumn("has_image", F.lit(True))
    right = stats.withColumn("has_annotation", F.lit(True))
    both = left.join(right, "sample_id", "full")
    state = (
        F.when(F.col("has_image").isNull(), "ORPHAN")
        .when(F.col("has_annotation").isNull(), "MISSING_ANNOTATION")
        .when(~F.col("readable"), "JSON_READ_FAILED")
        .when(F.col("image_width").isNull(), "IMAGE_READ_FAILED")
        .when(~F.col("is_object"), "NOT_AN_OBJECT")
        .otherwise("INSPECTED")
    )
    seen = F.col("state") == "INSPECTED"
    mismatch = seen & ((F.col("width") != F.col("image_width")) | (F.col("height") != F.col("image_height")))
    overflow = seen & (F.col("overflow_count") > 0)
    counted = lambda c: F.when(seen, F.col(c)).otherwise(0).cast("int")
    return both.withColumn("state", state).select(
        "sample_id", "image_path", "json_path", "state",
        F.col("state").isin("ORPHAN", "MISSING_ANNOTATION").__invert__().alias("paired"),
        counted("point_count").alias("point_count"), counted("edge_count").alias("edge_count"),
        F.when(seen, F.col("issue_count")).when(F.col("state") == "ORPHAN", 0).otherwise(1).cast("int").alias("error_count"),
        (mismatch.cast("int") + overflow.cast("int")).alias("warning_count"),
        mismatch.alias("size_mismatch"), counted("overflow_count").alias("overflow_count"),
        F.when(overflow, F.col("overflow_shown")).otherwise("").alias("overflow_shown"),
        "width", "height", "image_width", "image_height",
    )


def summarize(inspected: DataFrame) -> DataFrame:
    """The fifteen counters, one row. Counters that nothing raised are 0."""
    paired = F.col("paired")
    count = lambda condition: F.count_if(condition)
    return inspected.agg(
        count(F.col("state") != "ORPHAN").alias("num_images"),
        count(F.col("state") != "MISSING_ANNOTATION").alias("num_annotations"),
        count(paired).alias("paired_samples"),
        count(F.col("state") == "MISSING_ANNOTATION").alias("missing_annotations"),
        count(F.col("state") == "ORPHAN").alias("orphan_annotations"),
        count(paired & (F.col("error_count") > 0)).alias("samples_with_errors"),
        count(paired & (F.col("warning_count") > 0)).alias("samples_with_warnings"),
        count(F.col("state") == "JSON_READ_FAILED").alias("invalid_json"),
        count(F.col("state") == "IMAGE_READ_FAILED").alias("invalid_image"),
        count(paired & (F.col("overflow_count") > 0)).alias("degree_overflow_samples"),
        count(paired & (F.col("point_count") == 0)).alias("zero_point_samples"),
        count(paired & (F.col("point_count") == 1)).alias("one_point_samples"),
        count(paired & (F.col("edge_count") == 0)).alias("zero_edge_samples"),
        count(paired & (F.col("edge_count") > 0)).alias("samples_with_edges"),
        count(paired & (F.col("point_count") > 0)).alias("samples_with_points"),
    )


def histogram(inspected: DataFrame) -> DataFrame:
    """(kind, bucket, n) of point and link counts, capped at 20."""
    capped = lambda c: F.least(F.col(c), F.lit(HISTOGRAM_CAP))
    pairs = F.array(
        F.struct(F.lit("points").alias("kind"), capped("point_count").alias("bucket")),
        F.struct(F.lit("edges").alias("kind"), capped("edge_count").alias("bucket")),
    )
    return inspected.where("paired").select(F.inline(pairs)).groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"))


def finding_flags() -> dict[str, Column]:
    paired = F.col("paired")
    return dict(
        zip(
            FINDING_ORDER,
            (
                F.col("state") == "MISSING_ANNOTATION", F.col("state") == "ORPHAN",
                paired & (F.col("error_count") > 0), paired & (F.col("warning_count") > 0),
                paired & (F.col("point_count") == 0), paired & (F.col("point_count") == 1), paired & (F.col("edge_count") == 0),
            ),
        )
    )


def findings(inspected: DataFrame) -> DataFrame:
    """(sample_id, category) rows: the id lists of the report as a table."""
    flags = [F.when(flag, F.lit(name)) for name, flag in finding_flags().items()]
    return inspected.select("sample_id", F.explode(F.array_compact(F.array(*flags))).alias("category"))


def findings_digest(inspected: DataFrame) -> DataFrame:
    """(sample_id, line): the categories of each sample in fixed order."""
    labels = F.concat_ws(", ", *[F.when(flag, F.lit(name)) for name, flag in finding_flags().items()])
    return inspected.select("sample_id", labels.alias("labels")).where("labels <> ''").select(
        "sample_id", F.format_string("[%s] %s", F.col("sample_id").cast("string"), F.col("labels")).alias("line")
    )


def sample_messages(inspected: DataFrame, issues: DataFrame) -> DataFrame:
    """All error and warning messages as rows (sample_id, level, part, pos, code, message)."""
    own = issues.join(inspected.where("state = 'INSPECTED'").select("sample_id"), "sample_id", "left_semi")
    failed = inspected.where(F.col("state").isin("MISSING_ANNOTATION", "JSON_READ_FAILED", "IMAGE_READ_FAILED", "NOT_AN_OBJECT", "ORPHAN"))
    text = F.create_map(*[F.lit(x) for code in ("MISSING_ANNOTATION", "JSON_READ_FAILED", "IMAGE_READ_FAILED", "NOT_AN_OBJECT") for x in (code, ISSUE_TEXT[code])],
                        F.lit("ORPHAN"), F.lit(ISSUE_TEXT["MISSING_IMAGE"]))
    failed = failed.select("sample_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit("error").alias("level"),
                           F.col("state").alias("code"), text[F.col("state")].alias("message"))
    sizes = ("width", "height", "image_width", "image_height")
    warned = inspected.where("warning_count > 0").select(
        "sample_id",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(F.col("size_mismatch"), issue(4, F.lit(0), "SIZE_MISMATCH", *[F.col(c).cast("int") for c in sizes], level="warning")),
                    F.when(F.col("overflow_count") > 0,
                           issue(4, F.lit(1), "DEGREE_OVERFLOW", F.col("overflow_count"), F.col("overflow_shown"), level="warning")),
                )
            )
        ),
    )
    columns = ("sample_id", "level", "part", "pos", "code", "message")
    return own.select(*columns).unionByName(failed.select(*columns)).unionByName(warned.select(*columns))


def digest_lines(inspected: DataFrame, issues: DataFrame) -> DataFrame:
    """Digest with details: rows (sample_id, part, pos, line); order by the first three to print it."""
    digest = findings_digest(inspected)
    head = digest.select("sample_id", F.lit(-2).alias("part"), F.lit(0).alias("pos"), "line")
    counts = inspected.where("paired").join(digest.select("sample_id"), "sample_id", "left_semi").select(
        "sample_id", F.lit(-1).alias("part"), F.lit(0).alias("pos"),
        F.format_string("  counts: points=%d edges=%d", "point_count", "edge_count").alias("line"),
    )
    told = sample_messages(inspected, issues).join(digest.select("sample_id"), "sample_id", "left_semi")
    details = told.select("sample_id", "part", "pos", F.format_string("  %s: %s", "level", "message").alias("line"))
    return head.unionByName(counts).unionByName(details)


def summary_lines(summary: DataFrame) -> DataFrame:
    """The four report lines as rows (line_no, line)."""
    lines = [
        ("images=%d annotations=%d paired=%d", "num_images", "num_annotations", "paired_samples"),
        ("missing_annotations=%d orphan_annotations=%d", "missing_annotations", "orphan_annotations"),
        ("zero_point=%d one_point=%d zero_edge=%d", "zero_point_samples", "one_point_samples", "zero_edge_samples"),
        ("samples_with_errors=%d samples_with_warnings=%d", "samples_with_errors", "samples_with_warnings"),
    ]
    return summary.select(F.posexplode(F.array(*[F.format_string(*line) for line in lines])).alias("line_no", "line"))


def validate(images: DataFrame, stats: DataFrame) -> ValidationResult:
    """All report tables over one inspection. Callers that use several should pass a materialised `stats`."""
    inspected = inspect(images, stats)
    return ValidationResult(summarize(inspected), inspected, histogram(inspected), findings(inspected))
