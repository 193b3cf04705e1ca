"""Model-assisted steps: scoring with a user's model, peaks, merging of near points, link selection."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from annograph.functions.text import numbered
from annograph.operators import pick_arrays
from annograph.plans.groups import map_groups, whole_groups
from annograph.plans.session import materialize
from annograph.plans.skew import RANGE_ROWS, hot_groups, rank_rows, running, split_hot, split_large
from annograph.schemas import LINK_SOURCE, POSTPROCESS_PRESETS

MERGE_LIMIT = 512    # points of one image merged inside one task call
MERGE_WINDOW = 2048  # points of one larger image whose pairs are held by one window
SELECT_LIMIT = 50_000  # links of one sample selected inside one task call
WINDOW_ROUNDS = 4  # rounds of three steps along links before long groups are left to jumps


# ---------------------------------------------------------------- scoring


def score_heatmaps(images: DataFrame, make_model: Callable, shape: list[int], pixels: str = "pixels", batch_size: int = 32) -> DataFrame:
    """Add `heatmap` (array<float>). `make_model()` runs once per Python worker and returns a function on numpy batches
    of arrays with the given shape."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    predict = predict_batch_udf(make_model, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[shape])
    return images.withColumn("heatmap", predict(F.col(pixels)))


def run_detector(images: DataFrame, make_detector: Callable, content: str = "content") -> DataFrame:
    """Plug-in detector: `make_detector()` returns bytes -> [(x, y, score)]; built once per Python worker.

    Rows (all input columns but the content, x, y, score).
    """
    keep = [c for c in images.columns if c != content]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name in keep) + ", x double, y double, score double"

    def run(batches):
        import pandas as pd

        detector = make_detector()
        for batch in batches:
            rows = [
                (*[getattr(r, c) for c in keep], float(x), float(y), float(s))
                for r in batch.itertuples(index=False) for x, y, s in detector(bytes(getattr(r, content)))
            ]
            yield pd.DataFrame(rows, columns=[*keep, "x", "y", "score"])

    return images.mapInPandas(run, schema)


def heatmap_pixels(maps: DataFrame, width: int, array: str = "heatmap") -> DataFrame:
    """Row-major maps to (image_id, x, y, v)."""
    return maps.select("image_id", F.posexplode(array).alias("n", "v")).select(
        "image_id", (F.col("n") % width).cast("int").alias("x"), F.floor(F.col("n") / width).cast("int").alias("y"), F.col("v").cast("double").alias("v")
    )


def peaks(pixels: DataFrame, threshold: float = 0.5, reach: int = 2) -> DataFrame:
    """Local maxima of a (2*reach+1) square above the threshold.

    The square maximum is the column maximum of row maxima, so each window holds one line of one map, never a whole map.
    """
    line = W.partitionBy("image_id", "y").orderBy("x").rangeBetween(-reach, reach)
    column = W.partitionBy("image_id", "x").orderBy("y").rangeBetween(-reach, reach)
    top = pixels.withColumn("row_max", F.max("v").over(line)).withColumn("top", F.max("row_max").over(column))
    return top.where((F.col("v") == F.col("top")) & (F.col("v") > threshold)).select("image_id", "x", "y", F.col("v").alias("score"))


def predict_points(
    images: DataFrame, make_model: Callable, shape: list[int], width: int, threshold: float = 0.3, reach: float = 15.0, pixels: str = "pixels"
) -> DataFrame:
    """Images to points: model maps of the given width, peaks, merging. Input and output are keyed by image_id."""
    maps = score_heatmaps(images, make_model, shape, pixels).select("image_id", "heatmap")
    found = peaks(heatmap_pixels(maps, width), threshold)
    spots = found.select("image_id", (F.col("y") * width + F.col("x")).cast("int").alias("idx"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "score")
    return merge_near_points(materialize(spots, "peaks"), reach)


def augmentation_mean(branches: DataFrame, size: int) -> DataFrame:
    """Mean map of seven aligned branches over square maps.

    `branches` holds (image_id, branch, x, y, v) in the coordinates of the transformed image: 0 plain, 1 mirrored in x,
    2 mirrored in y, 3 both, 4-6 turned by one to three quarter turns. Pixels go back to image coordinates and are averaged.
    """
    last = size - 1
    x, y, b = F.col("x"), F.col("y"), F.col("branch")
    back_x = F.when(b.isin(1, 3), last - x).when(b == 4, last - y).when(b == 5, last - x).when(b == 6, y).otherwise(x)
    back_y = F.when(b.isin(2, 3), last - y).when(b == 4, x).when(b == 5, last - y).when(b == 6, last - x).otherwise(y)
    return branches.groupBy("image_id", back_x.alias("x"), back_y.alias("y")).agg(F.avg("v").alias("v"))


# ---------------------------------------------------------------- merging near points


def merge_groups(x: list, y: list, reach: float) -> np.ndarray:
    """Complete-linkage groups cut at `reach`: a label (lowest member index) per point.

    All pairs that are nearest to each other merge in one round; equal distances go to the lower label.
    """
    xy = np.column_stack([x, y]).astype(np.float64)
    n = len(xy)
    gap = np.sqrt(((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1))
    gap[gap > reach] = np.inf
    np.fill_diagonal(gap, np.inf)
    label = np.arange(n)
    while n:
        nearest = gap.argmin(1)
        low = np.flatnonzero((nearest[nearest] == np.arange(n)) & np.isfinite(gap[np.arange(n), nearest]) & (np.arange(n) < nearest))
        if not len(low):
            break
        high = nearest[low]
        gap[low] = np.maximum(gap[low], gap[high])
        gap[:, low] = np.maximum(gap[:, low], gap[:, high])
        gap[high] = np.inf
        gap[:, high] = np.inf
        np.fill_diagonal(gap, np.inf)
        moved = np.arange(n)
        moved[high] = low
        label = moved[label]
    return label


def _merge_small(points: DataFrame, reach: float) -> DataFrame:
    def run(key, columns):
        labels = merge_groups(columns["x"], columns["y"], reach)
        for idx, label in zip(columns["idx"], labels):
            yield key[0], idx, columns["idx"][label]

    kind = points.schema["image_id"].dataType.simpleString()
    return map_groups(points.select("image_id", "idx", "x", "y"), ["image_id"], ["idx"], run, f"image_id {kind}, idx int, cluster int")


def _merge_large(points: DataFrame, reach: float) -> DataFrame:
    """The points with their `cluster`, by rounds on the pairs within reach; only those pairs can ever merge.

    Points at one spot merge first (distance 0), so the pair table starts from distinct spots.
    """
    (held,), rest = split_large([points], ["image_id"], MERGE_WINDOW)
    merged = _merge_windows(held, reach)
    if rest is None:
        return merged
    return merged.unionByName(rest[0].join(_merge_joins(rest[0], reach), ["image_id", "idx"]))


def _merge_windows(points: DataFrame, reach: float) -> DataFrame:
    """The rounds as windows of one image each. Pairs are sent once a round, and only those that are left."""
    placed = points.dropna(subset=["image_id", "idx", "x", "y"])
    placed = materialize(placed.withColumn("spot", F.min("idx").over(W.partitionBy("image_id", "x", "y"))), "merge")
    spots = placed.where("idx = spot").select("image_id", F.col("spot").alias("a"), "x", "y")
    others = spots.select("image_id", F.col("a").alias("b"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    pairs = spots.join(others, "image_id").where("a <> b").select("image_id", "a", "b", F.sqrt(dx * dx + dy * dy).alias("d"))
    pairs, moves = pairs.where(F.col("d") <= reach), []
    while True:
        done = materialize(_merge_round(pairs), "merge")
        moves.append(done.where("a = b").select("image_id", "old", F.col("a").alias("new")))
        pairs = done.where("a <> b").select("image_id", "a", "b", "d").repartition("image_id")
        if not done.where("a <> b").limit(1).count():
            break
    ends = reduce(DataFrame.unionByName, moves).repartition("image_id")
    for _ in range((len(moves) - 1).bit_length()):  # each step doubles how many rounds a move spans
        told = F.struct(F.col("old").alias("key"), F.col("new").alias("end"), F.lit(None).cast(ends.schema["old"].dataType).alias("old"))
        asks = F.struct(F.col("new").alias("key"), F.lit(None).cast(ends.schema["new"].dataType).alias("end"), F.col("old").alias("old"))
        both = ends.select("image_id", F.inline(F.array(told, asks)))
        found = both.withColumn("end", F.max("end").over(W.partitionBy("image_id", "key"))).where("old is not null")
        ends = found.select("image_id", "old", F.coalesce("end", "key").alias("new"))
    ends = ends.withColumnRenamed("old", "spot")
    return placed.join(ends, ["image_id", "spot"], "left").select(*points.columns, F.coalesce("new", "spot").alias("cluster"))


def _merge_round(pairs: DataFrame) -> DataFrame:
    """Pairs (image_id, a, b, d), in both directions, after one round, and as rows with a = b the merged ones: `old` became `a`."""
    of_a, of_pair = W.partitionBy("image_id", "a"), W.partitionBy("image_id", "low", "high")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    near = F.min(F.struct("d", "b")).over(of_a)["b"] == F.col("b")
    state = pairs.withColumns({"low": low, "high": high, "near": near}).withColumn("mutual", F.min("near").over(of_pair))
    state = state.withColumn("new_a", F.max(F.when(F.col("mutual"), F.col("low"))).over(of_a))
    end = lambda side: F.max(F.when(F.col("a") == F.col(side), F.col("new_a"))).over(of_pair)
    state = state.withColumn("new_b", F.when(F.col("b") == F.col("low"), end("low")).otherwise(end("high")))
    parts = F.when(F.col("new_a").isNull(), 1).otherwise(2) * F.when(F.col("new_b").isNull(), 1).otherwise(2)
    renamed = state.select("image_id", F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b"), "d", parts.alias("parts"), F.col("high").alias("old"))
    # the merged distance is the largest one, and stays only if every part is within reach
    merged = renamed.groupBy("image_id", "a", "b").agg(
        F.max("d").alias("d"), F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"), F.max("old").alias("old")
    )
    return merged.where("a = b or n = parts").select("image_id", "a", "b", "d", "old")


def _merge_joins(points: DataFrame, reach: float) -> DataFrame:
    """The same rounds as joins, for images of any size: (image_id, idx, cluster)."""
    points = materialize(points.select("image_id", "idx", "x", "y"), "merge")
    spots = points.groupBy("image_id", "x", "y").agg(F.min("idx").alias("spot"))
    cell = max(reach, 1e-6)
    placed = spots.select("image_id", "spot", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    other = placed.select("image_id", F.col("spot").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy", F.explode(steps).alias("s"))
    other = other.select("image_id", "o", "ox", "oy", (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    pairs = placed.join(other, ["image_id", "cx", "cy"]).where("spot <> o").select(
        "image_id", F.col("spot").alias("a"), F.col("o").alias("b"), F.sqrt(dx * dx + dy * dy).alias("d")
    )
    pairs = materialize(pairs.where(F.col("d") <= reach), "merge")
    labels = materialize(spots.select("image_id", "spot", F.col("spot").alias("cluster")), "merge")
    while True:
        nearest = pairs.groupBy("image_id", "a").agg(F.min(F.struct("d", "b")).alias("n")).select("image_id", "a", F.col("n.b").alias("b"))
        mutual = nearest.join(nearest.select("image_id", F.col("a").alias("b"), F.col("b").alias("a")), ["image_id", "a", "b"])
        moves = materialize(mutual.where("a < b").select("image_id", F.col("b").alias("old"), F.col("a").alias("new")), "merge")
        if not moves.limit(1).count():
            break
        labels = materialize(
            labels.join(moves.withColumnRenamed("old", "cluster"), ["image_id", "cluster"], "left").select("image_id", "spot", F.coalesce("new", "cluster").alias("cluster")),
            "merge",
        )
        sizes = moves.select("image_id", F.explode(F.array("old", "new")).alias("m"), "new")
        side = lambda s: sizes.select("image_id", F.col("m").alias(s), F.col("new").alias(f"new_{s}"))
        renamed = pairs.join(side("a"), ["image_id", "a"], "left").join(side("b"), ["image_id", "b"], "left")
        parts = F.when(F.col("new_a").isNull(), 1).otherwise(2) * F.when(F.col("new_b").isNull(), 1).otherwise(2)
        renamed = renamed.select("image_id", F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b"), "d", parts.alias("parts")).where("a <> b")
        # the merged distance is the largest one, and stays only if every part is within reach
        pairs = materialize(
            renamed.groupBy("image_id", "a", "b").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"))
            .where("n = parts").select("image_id", "a", "b", "d"),
            "merge",
        )
    return points.join(spots, ["image_id", "x", "y"]).join(labels, ["image_id", "spot"]).select("image_id", "idx", "cluster")


def merge_near_points(points: DataFrame, reach: float = 15.0, limit: int = MERGE_LIMIT) -> DataFrame:
    """Keep the best-scored point of each complete-linkage group (first index on equal scores).

    `points`: image_id, idx, x, y, score with idx unique per image.
    """
    small, large = split_hot(points, ["image_id"], limit) if limit > 0 else (None, points)
    merged = [] if small is None else [small.join(_merge_small(small, reach), ["image_id", "idx"])]
    if large is not None:
        merged.append(_merge_large(large.select("image_id", "idx", "x", "y", "score"), reach))
    return best_per_cluster(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), merged))


def best_per_cluster(points: DataFrame) -> DataFrame:
    best = F.max(F.struct(F.col("score"), (-F.col("idx")).alias("order"), F.col("x"), F.col("y"))).alias("b")
    return points.groupBy("image_id", "cluster").agg(best).select(
        "image_id", (-F.col("b.order")).alias("idx"), F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.score").alias("score")
    )


def tile_points(detections: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile detections in image coordinates, kept when inside the image. `tiles`: image_id, tile, x0, y0, width, height."""
    moved = detections.join(tiles, ["image_id", "tile"]).select(
        "image_id", "tile", (F.col("x") + F.col("x0")).cast("double").alias("x"), (F.col("y") + F.col("y0")).cast("double").alias("y"), "score", "width", "height"
    )
    return moved.where("x < width and y < height").drop("width", "height")


def inside_image(points: DataFrame) -> DataFrame:
    return points.where("x >= 0 and x < width and y >= 0 and y < height")


# ---------------------------------------------------------------- link selection


def resolve_preset(preset: str = "balanced", **overrides) -> dict:
    """Selection parameters of a preset with single values replaced. An unknown preset is an error."""
    if preset not in POSTPROCESS_PRESETS:
        raise ValueError(f"unknown preset: {preset}")
    unknown = set(overrides) - set(POSTPROCESS_PRESETS[preset])
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return {**POSTPROCESS_PRESETS[preset], **{k: v for k, v in overrides.items() if v is not None}}


def above_threshold(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Links with score >= threshold, numbered in (u, v) order. Input: sample_id, u, v, score.

    The kept links are written first, so that a model behind `scored` runs once.
    """
    kept = materialize(scored.where(F.col("score") >= threshold), "scored")
    return rank_rows(kept, ["sample_id"], ["u", "v"], "n").select(
        "sample_id", numbered("pred_edge_", F.col("n")).alias("edge_id"), F.col("u").alias("src"), F.col("v").alias("dst"), "score",
        F.lit(1).alias("label"), F.lit(LINK_SOURCE).alias("source"), (F.col("n") - 1).alias("pos"),
    )


def straightness(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """0.5 (1 - cos) of the angle at point 0 between points 1 and 2: 1 straight on, 0 folded back or degenerate."""
    ax, ay, bx, by = x1 - x0, y1 - y0, x2 - x0, y2 - y0
    na, nb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (na * nb)))
    return F.when((na < 1e-6) | (nb < 1e-6), 0.0).otherwise(0.5 * (1.0 - cos))


def continuity_bonus(links: DataFrame, kept: DataFrame, points: DataFrame) -> DataFrame:
    """Bonus of each directed link (sample_id, node, other) against kept links: only nodes with exactly one kept neighbour."""
    ends = kept.select("sample_id", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("near")), F.struct(F.col("v").alias("node"), F.col("u").alias("near")))).alias("e")).select("sample_id", "e.*")
    single = ends.groupBy("sample_id", "node").agg(F.countDistinct("near").alias("n"), F.min("near").alias("near"))
    xy = lambda role: points.select("sample_id", F.col("id").alias(role), F.col("x").alias(f"x_{role}"), F.col("y").alias(f"y_{role}"))
    j = links.join(single, ["sample_id", "node"], "left")
    for role in ("node", "other", "near"):
        j = j.join(xy(role), ["sample_id", role], "left")
    bonus = straightness(*[F.col(c) for c in ("x_node", "y_node", "x_near", "y_near", "x_other", "y_other")])
    return j.select("sample_id", "node", "other", F.when(F.col("n") == 1, F.coalesce(bonus, F.lit(0.0))).otherwise(0.0).alias("bonus"))


def path_lengths(edges: DataFrame, queries: DataFrame, max_depth: int) -> DataFrame:
    """Shortest path length (null beyond max_depth) of each (sample_id, src, dst) over undirected edges (sample_id, u, v).

    One join per step; the frontier is made distinct and drops nodes reached before.
    """
    both = edges.select("sample_id", "u", "v").unionByName(edges.select("sample_id", F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    asked = queries.select("sample_id", "src", "dst").distinct()
    start = asked.select("sample_id", "src").distinct().withColumn("node", F.col("src"))
    reached = frontier = start.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        step = frontier.join(both.withColumnRenamed("u", "node"), ["sample_id", "node"]).select("sample_id", "src", F.col("v").alias("node")).distinct()
        frontier = step.join(reached.select("sample_id", "src", "node"), ["sample_id", "src", "node"], "left_anti").withColumn("depth", F.lit(depth))
        reached = reached.unionByName(frontier)
    return asked.join(reached.withColumnRenamed("node", "dst"), ["sample_id", "src", "dst"], "left").select("sample_id", "src", "dst", F.col("depth").alias("path_len"))


def straight(at: complex, one: complex, other: complex) -> float:
    """`straightness` of points as complex numbers: the cosine is the real part of one arm times the other's conjugate."""
    arms = one - at, other - at
    lengths = [(a * a.conjugate()).real ** 0.5 for a in arms]
    if min(lengths) < 1e-6:
        return 0.0
    cosine = (arms[0] * arms[1].conjugate()).real / (lengths[0] * lengths[1])
    return (1.0 - min(max(cosine, -1.0), 1.0)) / 2


def link_value(link: tuple, lone: dict, spots: dict, weight: float) -> float:
    """Score of a link (src, dst, score) plus the bonus at each end that has a `lone` kept neighbour and known places."""
    value = link[2]
    for here, there in (link[:2], link[1::-1]):
        mate = lone.get(here)
        if mate is not None and {here, there, mate} <= spots.keys():
            value += weight * straight(spots[here], spots[mate], spots[there])
    return value


def within_steps(near: dict, start, goal, steps: int) -> bool:
    """Whether `goal` is at most `steps` kept links from `start`."""
    seen = ring = {start}
    for _ in range(steps):
        if goal in ring:
            return True
        ring = set().union(*(near.get(n, ()) for n in ring)) - seen
        seen = seen | ring
    return goal in ring


def pick_links(src, dst, score, xy, max_degree: int, max_cycle: int, weight: float) -> list[tuple[int, float, int]]:
    """Greedy choice inside one connected group, in the order of picking: [(list index, floor, index at the floor)].

    The last two are the largest (falling value, index) so far: a group's picks are merged with those of other groups of
    the sample in that order. A link that would close a cycle of at most `max_cycle` links stays impossible from then
    on, so it is dropped. Values of links change only at the ends of the link just taken; a stale heap entry is skipped.
    """
    links = list(zip(src, dst, score))
    spots = {node: complex(*place) for node, place in xy.items()} if xy else {}
    near, lone, degree, incident = {}, {}, {}, {}
    for i, link in enumerate(links):
        for end in link[:2]:
            incident.setdefault(end, []).append(i)
    value = dict(enumerate(score))  # of the links that may still be taken
    heap = [(-v, i) for i, v in value.items()]
    heapq.heapify(heap)
    kept, last = [], (-float("inf"), -1)
    while heap:
        entry = heapq.heappop(heap)
        i = entry[1]
        if value.get(i) != -entry[0]:
            continue
        del value[i]
        ends = links[i][:2]
        if max_cycle >= 3 and within_steps(near, *ends, max_cycle - 1):
            continue
        last = max(last, entry)
        kept.append((i, -last[0], last[1]))
        for here, there in (ends, ends[::-1]):
            degree[here] = degree.get(here, 0) + 1
            near.setdefault(here, set()).add(there)
            lone[here] = there if len(near[here]) == 1 else None
        for here in ends:
            for e in incident[here]:
                if e in value:
                    if degree[here] >= max_degree:
                        del value[e]
                        continue
                    fresh = link_value(links[e], lone, spots, weight)
                    if fresh != value[e]:
                        value[e] = fresh
                        heapq.heappush(heap, (-fresh, e))
    return kept


def connected_groups(links: DataFrame, limit: int = RANGE_ROWS) -> DataFrame:
    """(sample_id, node, component) with the least node id as component.

    Samples of at most `limit` links take windows, which send each link once a round; larger ones, and those whose groups are
    too long to settle in a few rounds, take joins with jumps.
    """
    named = links.select("sample_id", "src", "dst").dropna()
    (cold,), hot = split_large([named], ["sample_id"], limit)
    u, v = F.least("src", "dst"), F.greatest("src", "dst")
    state = cold.select("sample_id", u.alias("u"), v.alias("v"), F.explode(F.array("src", "dst")).alias("node"), u.alias("c"))
    settled, rest = [], [] if hot is None else hot
    for _ in range(WINDOW_ROUNDS):
        spread = state.repartition("sample_id")
        for _ in range(3):
            at_node = F.min("c").over(W.partitionBy("sample_id", "node"))
            spread = spread.withColumn("was", F.col("c")).withColumn("c", at_node)
            spread = spread.withColumn("c", F.min("c").over(W.partitionBy("sample_id", "u", "v")))
        moved = F.max(F.col("c") != F.col("was")).over(W.partitionBy("sample_id"))
        state = materialize(spread.withColumn("open", moved).drop("was"), "component")
        settled.append(state.where("not open").groupBy("sample_id", "node").agg(F.min("c").alias("component")))
        state = state.where("open").drop("open")
        if not state.limit(1).count():
            break
    else:
        rest = [*rest, state.select("sample_id", F.col("u").alias("src"), F.col("v").alias("dst"))]
    if rest:
        settled.append(_groups_by_joins(reduce(DataFrame.unionByName, rest)))
    return reduce(DataFrame.unionByName, settled)


def _groups_by_joins(links: DataFrame) -> DataFrame:
    """The same by repeated neighbour minima and jumps, for groups of any size and length."""
    both = materialize(
        links.select("sample_id", F.col("src").alias("node"), F.col("dst").alias("other"))
        .unionByName(links.select("sample_id", F.col("dst").alias("node"), F.col("src").alias("other"))).distinct(),
        "links",
    )
    label = materialize(both.groupBy("sample_id", "node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "component")
    while True:
        other = label.select("sample_id", F.col("node").alias("other"), F.col("component").alias("c"))
        pulled = both.join(other, ["sample_id", "other"]).groupBy("sample_id", "node").agg(F.min("c").alias("c"))
        lowered = label.join(pulled, ["sample_id", "node"]).select("sample_id", "node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        jump = label.select("sample_id", F.col("node").alias("component"), F.col("component").alias("root"))
        lowered = materialize(
            lowered.join(jump, ["sample_id", "component"], "left").select("sample_id", "node", "was", F.least("component", F.coalesce("root", "component")).alias("component")),
            "component",
        )
        label = lowered.select("sample_id", "node", "component")
        if not lowered.where("was <> component").limit(1).count():
            return label


def select_links(
    links: DataFrame, points: DataFrame | None = None, preset: str = "balanced", limit: int = SELECT_LIMIT, **overrides
) -> DataFrame:
    """Degree-limited selection of scored links, renumbered by score.

    `links`: sample_id, pos (list order), src, dst, score. `points`: sample_id, id, x, y switches the straightness bonus on.
    Links influence each other only within a connected group, so samples above `limit` links are processed per group.
    `cycle_penalty` is accepted but cannot change the result: a link it would lower is never kept.
    """
    p = resolve_preset(preset, **overrides)
    rows = links.select("sample_id", "pos", "src", "dst", F.col("score").cast("double").alias("score"))
    if p["max_degree"] <= 0:
        return _numbered_links(rows.where("false").selectExpr("*", "score as floor", "pos as at", "pos as turn"))
    heavy = hot_groups(rows.select("sample_id"), ["sample_id"], limit)
    if heavy is None:
        return _numbered_links(_pick(rows, points, ["sample_id"], p))
    part = lambda t, how: None if t is None else t.join(heavy, "sample_id", how)
    small = _numbered_links(_pick(part(rows, "left_anti"), part(points, "left_anti"), ["sample_id"], p))
    large, spots = materialize(part(rows, "left_semi"), "select"), part(points, "left_semi")
    groups = materialize(connected_groups(large), "component")
    grouped = large.join(groups.withColumnRenamed("node", "src"), ["sample_id", "src"])
    if spots is not None:
        spots = spots.join(groups.withColumnRenamed("node", "id"), ["sample_id", "id"])
    picked = materialize(_pick(grouped, spots, ["sample_id", "component"], p), "select")
    return small.unionByName(_numbered_large(picked))


def _pick(links: DataFrame, points: DataFrame | None, keys: list[str], p: dict) -> DataFrame:
    """Greedy choice per group. Points travel in the same stream as the links of their group, so nothing is joined."""
    degree, cycle, weight = int(p["max_degree"]), int(p["max_small_cycle_length"]), float(p["continuity_weight"])
    none = F.lit(None)
    rows = links.select(*keys, F.lit(1).alias("kind"), "pos", "src", "dst", "score", none.cast("double").alias("x"), none.cast("double").alias("y"))
    if points is not None:
        spots = points.select(*keys, F.lit(0).alias("kind"), F.lit(0).alias("pos"), F.col("id").alias("src"), F.lit(0).alias("dst"), F.lit(0.0).alias("score"), "x", "y")
        rows = rows.unionByName(spots)
    with_points = points is not None
    kind = links.schema["sample_id"].dataType
    schema = pa.schema([("sample_id", to_arrow_type(kind)), ("pos", pa.int32()), ("src", pa.int32()), ("dst", pa.int32()), ("score", pa.float64()), ("floor", pa.float64()), ("at", pa.int32()), ("turn", pa.int32())])

    def one_by_one(rows: pa.Table, group: np.ndarray) -> Iterator[tuple]:
        """Picks of the groups that do not fit arrays."""
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
        for begin, end in zip(starts, [*starts[1:], len(group)]):
            c = rows.slice(begin, end - begin).to_pydict()
            first = c["kind"].index(1) if 1 in c["kind"] else len(c["kind"])
            xy = {i: (x, y) for i, x, y in zip(c["src"][:first], c["x"][:first], c["y"][:first])} if with_points else None
            src, dst, score, pos = (c[n][first:] for n in ("src", "dst", "score", "pos"))
            for turn, (i, floor, at) in enumerate(pick_links(src, dst, score, xy, degree, cycle, weight)):
                yield c["sample_id"][0], pos[i], src[i], dst[i], score[i], floor, pos[at], turn

    def run(batches):
        for rows, group in whole_groups(batches, keys):
            is_link = rows.column("kind").to_numpy() == 1
            plain = np.ones(group[-1] + 1, bool)
            for name, where in (("pos", is_link), ("src", is_link), ("dst", is_link), ("score", is_link), ("src", ~is_link), ("x", ~is_link), ("y", ~is_link)):
                if rows.column(name).null_count:
                    plain[group[where & rows.column(name).is_null().to_numpy()]] = False
            fits = plain[group]
            at = np.flatnonzero(fits & is_link)
            number = lambda name, rows_: rows.column(name).take(pa.array(rows_)).to_numpy()
            names, dense = np.unique(group[at], return_inverse=True)
            spots = None
            if with_points:
                place = np.searchsorted(names, group)
                here = np.flatnonzero(fits & ~is_link & (place < len(names)))
                here = here[names[place[here]] == group[here]]
                spots = (place[here], number("src", here), number("x", here), number("y", here))
            done, (link, floor, low, turn) = pick_arrays.pick(dense, number("src", at), number("dst", at), number("score", at), spots, degree, cycle, weight)
            picked, lowest = at[link.astype(np.int64)], at[low.astype(np.int64)]
            if len(picked):
                chosen = rows.select(["sample_id", "pos", "src", "dst", "score"]).take(pa.array(picked)).combine_chunks()
                arrays = [*(c.combine_chunks() for c in chosen.columns), pa.array(floor), pa.array(number("pos", lowest)), pa.array(turn.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            finished = np.zeros(group[-1] + 1, bool)
            finished[names[done]] = True
            rest = np.flatnonzero(~finished[group])
            rest = rest[np.isin(group[rest], group[is_link])]
            if len(rest):
                listed = list(one_by_one(rows.take(pa.array(rest)), group[rest]))
                if listed:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*listed), schema)], schema=schema)

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "kind", "pos")
    return ordered.mapInArrow(run, f"sample_id {kind.simpleString()}, pos int, src int, dst int, score double, floor double, at int, turn int")


def _numbered_links(picked: DataFrame) -> DataFrame:
    """Number kept links by score; equal scores keep the order of picking, which the floors give across groups."""
    order = W.partitionBy("sample_id").orderBy(F.desc("score"), F.desc("floor"), "at", "turn")
    return _link_rows(picked.withColumn("n", F.row_number().over(order)))


def _numbered_large(picked: DataFrame) -> DataFrame:
    """The same numbering through running counts."""
    keyed = picked.withColumn("s", -F.col("score")).withColumn("f", -F.col("floor"))
    ranked = running(keyed, ["sample_id"], "s", [("n", "sum", F.lit(1), True)], ["f", "at", "turn"])
    return _link_rows(ranked.withColumn("n", F.col("n").cast("int")))


def _link_rows(numbered_links: DataFrame) -> DataFrame:
    return numbered_links.select(
        "sample_id", numbered("pred_edge_", F.col("n")).alias("edge_id"), "src", "dst", "score", F.lit(1).alias("label"),
        F.lit(LINK_SOURCE).alias("source"),
    )


def predict_edges(
    points: DataFrame, scorer: Callable[[DataFrame, DataFrame], DataFrame], threshold: float = 0.5, preset: str = "balanced",
    truth: DataFrame | None = None, k: int = 8, radius_multiplier: float = 2.5, sizes: DataFrame | None = None, rounded: bool = True, **overrides,
) -> DataFrame:
    """Points to selected links: features, one scoring pass, threshold, selection.

    Selection sees whole coordinates, as batch documents hold them, unless `rounded` is off (single samples).

    `scorer(link features, node features)` adds a `score` column, for example with a column expression or a batch UDF.
    Truth links are left out of the candidates unless given.
    """
    from annograph.operators.graph import graph_features

    nodes, edges = graph_features(points, truth, sizes, k, radius_multiplier)
    scored = scorer(edges, nodes).select("sample_id", "u", "v", "score")
    places = points.withColumns({c: F.rint(c) for c in ("x", "y")}) if rounded else points
    return select_links(above_threshold(scored, threshold), places, preset, **overrides)
