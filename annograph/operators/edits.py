"""Edit logs and review merges as set operations on point and link tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annograph.functions.text import numbered
from annograph.plans.session import materialize
from annograph.plans.skew import rank_rows, split_large
from annograph.schemas import METADATA_LINK_REVIEW, METADATA_POINT_REVIEW

NEAR_LIMIT = 64  # points of a sample that a click is compared with one by one


def add_points(points: DataFrame, added: DataFrame) -> DataFrame:
    """Append (sample_id, seq, x, y) with ids after the largest one of the sample (0 when it has none)."""
    top = points.groupBy("sample_id").agg(F.max("id").alias("top"))
    new = rank_rows(added, ["sample_id"], ["seq"], "n").join(top, "sample_id", "left").select(
        "sample_id", (F.coalesce("top", F.lit(-1)) + F.col("n")).cast("int").alias("id"), "x", "y",
        F.lit(1.0).alias("score"), F.lit("manual").alias("source"),
    )
    return points.select("sample_id", "id", "x", "y", "score", "source").unionByName(new)


def toggle_edges(edges: DataFrame, toggles: DataFrame) -> DataFrame:
    """Links (sample_id, u, v) after toggles (sample_id, src, dst): an odd number of toggles flips presence."""
    flips = (
        toggles.groupBy("sample_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .agg((F.count(F.lit(1)) % 2 == 1).alias("odd")).where("odd")
    )
    base = edges.select("sample_id", "u", "v").distinct().withColumn("there", F.lit(True))
    both = base.join(flips, ["sample_id", "u", "v"], "full")
    return both.where(F.coalesce("there", F.lit(False)) != F.coalesce("odd", F.lit(False))).select(
        "sample_id", "u", "v", F.when(F.col("there"), "kept").otherwise("manual").alias("origin")
    )


def delete_points(points: DataFrame, edges: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove points (sample_id, id) and every link that touches one of them."""
    gone = deleted.select("sample_id", "id").distinct()
    left = points.join(gone, ["sample_id", "id"], "left_anti")
    links = edges
    for side in ("u", "v"):
        links = links.join(gone.withColumnRenamed("id", side), ["sample_id", side], "left_anti")
    return left, links


def move_points(points: DataFrame, moves: DataFrame) -> DataFrame:
    """Last write per point wins. `moves`: sample_id, id, seq, x, y."""
    last = moves.groupBy("sample_id", "id").agg(F.max_by(F.struct("x", "y"), "seq").alias("to"))
    return points.join(last, ["sample_id", "id"], "left").select(
        "sample_id", "id", F.coalesce("to.x", "x").alias("x"), F.coalesce("to.y", "y").alias("y"),
        *[c for c in points.columns if c not in ("sample_id", "id", "x", "y")],
    )


def clear_edges(edges: DataFrame, cleared: DataFrame) -> DataFrame:
    return edges.join(cleared.select("sample_id").distinct(), "sample_id", "left_anti")


def undo_last_edge(edges: DataFrame, undone: DataFrame) -> DataFrame:
    """Drop the link with the highest position in the named samples."""
    last = edges.join(undone.select("sample_id").distinct(), "sample_id", "left_semi").groupBy("sample_id").agg(F.max("pos").alias("pos"))
    return edges.join(last, ["sample_id", "pos"], "left_anti")


def review_metadata(kind: str, point_count: Column, edge_count: Column | None = None, **extra: Column) -> Column:
    """Metadata stamp of a reviewed annotation: `links` or `points` review."""
    values = {"source": F.lit(METADATA_LINK_REVIEW if kind == "links" else METADATA_POINT_REVIEW), **extra, "point_count": point_count}
    if edge_count is not None:
        values["edge_count"] = edge_count
    return F.struct(*[v.alias(k) for k, v in values.items()])


def merge_annotations(base: DataFrame, source: DataFrame) -> DataFrame:
    """Keep the base; take points (links) of the source only where the base has none.

    Both: sample_id, points, edges (normalised arrays), json_path. Adds `points_from`, `edges_from`, `merged_source_json`.
    """
    other = source.select("sample_id", F.col("points").alias("s_points"), F.col("edges").alias("s_edges"), F.col("json_path").alias("s_path"))
    j = base.join(other, "sample_id", "left")
    borrow = lambda mine, theirs: (F.size(mine) == 0) & (F.coalesce(F.size(theirs), F.lit(0)) > 0)
    p, e = borrow("points", "s_points"), borrow("edges", "s_edges")
    return j.select(
        "sample_id", F.when(p, F.col("s_points")).otherwise(F.col("points")).alias("points"),
        F.when(e, F.col("s_edges")).otherwise(F.col("edges")).alias("edges"),
        F.when(p, "source").otherwise("base").alias("points_from"), F.when(e, "source").otherwise("base").alias("edges_from"),
        F.col("s_path").alias("merged_source_json"),
    )


def merge_rows(base: DataFrame, source: DataFrame) -> DataFrame:
    """The merge rule on point or link rows: all base rows, and source rows of samples without any base row."""
    return base.unionByName(source.join(base.select("sample_id").distinct(), "sample_id", "left_anti"))


def load_precedence(images: DataFrame, output: DataFrame, source: DataFrame) -> DataFrame:
    """Which document a review starts from: the merged output, the output, a current source, a legacy source, or empty.

    `output` / `source`: sample_id, points, edges, width, height, json_path and for the source `legacy`.
    """
    out = output.select("sample_id", F.col("points").alias("o_points"), F.col("edges").alias("o_edges"), F.col("width").alias("o_w"), F.col("height").alias("o_h"))
    src = source.select("sample_id", F.col("points").alias("s_points"), F.col("edges").alias("s_edges"), F.col("width").alias("s_w"), F.col("height").alias("s_h"), "legacy", F.col("json_path").alias("s_path"))
    j = images.join(out, "sample_id", "left").join(src, "sample_id", "left")
    has_out, has_src = F.col("o_points").isNotNull(), F.col("s_points").isNotNull()
    origin = (
        F.when(has_out & has_src, "output+source").when(has_out, "output").when(has_src & ~F.col("legacy"), "source")
        .when(has_src, "legacy source").otherwise("empty")
    )
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    pick = lambda mine, theirs: F.when(has_out & ((size(mine) > 0) | (size(theirs) == 0)), F.col(mine)).otherwise(F.col(theirs))
    return j.select(
        "sample_id", origin.alias("origin"), pick("o_points", "s_points").alias("points"), pick("o_edges", "s_edges").alias("edges"),
        F.coalesce("o_w", "s_w", "image_width").alias("width"), F.coalesce("o_h", "s_h", "image_height").alias("height"),
        F.when(origin.isin("output+source", "legacy source"), F.col("s_path")).alias("source_json"),
    )


def nearest_point(points: DataFrame, clicks: DataFrame, radius: float, limit: int = NEAR_LIMIT) -> DataFrame:
    """Closest point of the clicked sample within `radius`; first id on equal distance.

    `clicks`: sample_id, click, qx, qy. In samples of at most `limit` points each click meets all points, so it is sent once;
    in the others it is sent to the nine cells around it, so a sample is never gathered.
    """
    points, clicks = points.select("sample_id", "id", "x", "y"), clicks.select("sample_id", "click", "qx", "qy")
    (near,), far = split_large([points.where(F.col("sample_id").isNotNull())], ["sample_id"], limit)
    found = _closest(clicks.join(near, "sample_id"), radius)
    if far is None:
        return found
    heavy = materialize(far[0].select("sample_id").distinct(), "hot")
    cell = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    placed = far[0].withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    asked = clicks.join(heavy, "sample_id", "left_semi").select("sample_id", "click", "qx", "qy", cell("qx").alias("qcx"), cell("qy").alias("qcy"))
    asked = asked.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps))
    asked = asked.select("sample_id", "click", "qx", "qy", (F.col("qcx") + F.col("a")).alias("cx"), (F.col("qcy") + F.col("b")).alias("cy"))
    return found.unionByName(_closest(asked.join(placed, ["sample_id", "cx", "cy"]), radius))


def _closest(joined: DataFrame, radius: float) -> DataFrame:
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    within = joined.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= radius)
    return within.groupBy("sample_id", "click").agg(F.min(F.struct("d", "id")).alias("m")).select(
        "sample_id", "click", F.col("m.id").alias("id"), F.col("m.d").alias("d")
    )


def edge_ids(edges: DataFrame) -> DataFrame:
    """Number links of each sample in `pos` order."""
    return rank_rows(edges, ["sample_id"], ["pos"], "n").select("sample_id", numbered("edge_", F.col("n")).alias("edge_id"), "u", "v")
