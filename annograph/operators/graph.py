"""Graph features: neighbour pairs, spacing, candidate links, node and link features, splits and summaries.

Points come normalised: ids of a sample are 0..n-1. Samples of at most PAIR_LIMIT points compare all their points (the
k nearest alone already name most pairs there). Larger samples are searched by tiles and leaves (`space`).
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from annograph.operators import feature_arrays
from annograph.operators.normalize import let
from annograph.operators.space import nearest_tiled, pairs_within
from annograph.plans.session import materialize
from annograph.plans.skew import running, split_hot
from annograph.schemas import DEFAULT_SIDE, DEFAULT_SPACING

PAIR_LIMIT = 64
NEAR = 3
RING_1, RING_2 = 1.2, 2.2
NODE_FEATURES = ("f_x", "f_y", "f_score", "f_nearest", "f_mean3", "f_ring1", "f_ring2", "f_valid")
EDGE_FEATURES = ("e_dx", "e_dy", "e_d", "e_abs_dx", "e_abs_dy", "e_score_u", "e_score_v", "e_score_gap", "e_ring1_u", "e_ring1_v")


def _quantile(ordered: Column, share: float) -> Column:
    """Linear quantile of a sorted array, as numpy computes it."""
    at = (F.size(ordered) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (at - low)


def _fenced_median(ordered: Column) -> Column:
    """Median of the values inside the 1.5 IQR fence."""

    def inside(q: Column) -> Column:
        iqr = F.greatest(q["q3"] - q["q1"], F.lit(1e-6))
        kept = F.filter(ordered, lambda v: (v >= q["q1"] - 1.5 * iqr) & (v <= q["q3"] + 1.5 * iqr))
        return let(kept, lambda k: _quantile(F.when(F.size(k) == 0, ordered).otherwise(k), 0.5))

    return let(F.struct(_quantile(ordered, 0.25).alias("q1"), _quantile(ordered, 0.75).alias("q3")), inside)


def nearest_stats(ranked: DataFrame) -> DataFrame:
    """(sample_id, i, nearest, mean3) from ranked neighbours (see `nearest_points`, k of at least 3)."""
    return ranked.groupBy("sample_id", "i").agg(
        F.min("d").alias("nearest"), F.avg(F.when(F.col("rank") <= NEAR, F.col("d"))).alias("mean3")
    )


def nearest_points(points: DataFrame, k: int = 8, limit: int = PAIR_LIMIT) -> DataFrame:
    """The k nearest neighbours (sample_id, i, j, d, rank) of every point; equal distances go to the lower index."""
    small, large = split_hot(points, ["sample_id"], limit)
    packed = small.groupBy("sample_id").agg(F.collect_list(F.struct("id", "x", "y")).alias("p"))
    near = let(F.array_sort("p"), lambda p: F.transform(p, lambda a: F.struct(a["id"].alias("i"), F.slice(_near_of(a, p), 1, k).alias("near"))))
    each = packed.select("sample_id", F.inline(near)).select("sample_id", "i", F.posexplode("near").alias("r", "n"))
    ranked = each.select("sample_id", "i", F.col("n.j").alias("j"), F.col("n.d").alias("d"), (F.col("r") + 1).alias("rank"))
    return ranked if large is None else ranked.unionByName(nearest_tiled(materialize(large, "points"), k))


def spacing(points: DataFrame, default: float = DEFAULT_SPACING, limit: int = PAIR_LIMIT) -> DataFrame:
    """(sample_id, spacing): fenced median of nearest distances; samples with fewer than two points get the default."""
    small, large = split_hot(points, ["sample_id"], limit)
    packed = small.groupBy("sample_id").agg(F.collect_list(F.struct("id", "x", "y")).alias("p"))
    nearest = let(F.col("p"), lambda p: F.transform(p, lambda a: F.get(_near_of(a, p), F.lit(0))["d"]))
    known = let(F.array_sort(F.array_compact(nearest)), lambda n: F.when(F.size(n) > 0, _fenced_median(n)))
    out = packed.select("sample_id", F.coalesce(known, F.lit(float(default))).alias("spacing"))
    if large is None:
        return out
    return out.unionByName(spacing_large(nearest_stats(nearest_tiled(materialize(large, "points"), NEAR))))


def _near_of(a: Column, p: Column) -> Column:
    """Other points of the row by distance, then index."""
    gap = lambda b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    return F.array_sort(F.transform(F.filter(p, lambda b: b["id"] != a["id"]), lambda b: F.struct(gap(b).alias("d"), b["id"].alias("j"))))


# ---------------------------------------------------------------- large samples


def _weighted_quantiles(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Exact linear quantiles of (sample_id, v) without gathering a sample: distinct values with counts, ranked by scan."""
    counts = materialize(values.groupBy("sample_id", "v").agg(F.count(F.lit(1)).alias("c")), "quantile")
    ranked = running(counts, ["sample_id"], "v", [("upto", "sum", F.col("c"), True)])
    ranked = ranked.join(counts.groupBy("sample_id").agg(F.sum("c").alias("n")), "sample_id")
    out = []
    for name, share in shares.items():
        at = (F.col("n") - 1) * F.lit(share)
        out.append(F.min(F.when(F.col("upto") > F.floor(at), F.col("v"))).alias(f"{name}_a"))
        out.append(F.min(F.when(F.col("upto") > F.least(F.floor(at) + 1, F.col("n") - 1), F.col("v"))).alias(f"{name}_b"))
        out.append(F.first(at - F.floor(at)).alias(f"{name}_t"))
    picked = ranked.groupBy("sample_id").agg(*out)
    blend = lambda n: (F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * F.col(f"{n}_t")).alias(n)
    return picked.select("sample_id", *[blend(n) for n in shares])


def spacing_large(stats: DataFrame) -> DataFrame:
    values = stats.select("sample_id", F.col("nearest").alias("v"))
    fence = _weighted_quantiles(values, {"q1": 0.25, "q3": 0.75})
    iqr = F.greatest(F.col("q3") - F.col("q1"), F.lit(1e-6))
    kept = values.join(fence, "sample_id").where((F.col("v") >= F.col("q1") - 1.5 * iqr) & (F.col("v") <= F.col("q3") + 1.5 * iqr))
    return _weighted_quantiles(kept.select("sample_id", "v"), {"spacing": 0.5})


# ---------------------------------------------------------------- nodes, candidates, features


def sample_rows(points: DataFrame, radius_multiplier: float, k: int) -> DataFrame:
    """One row per bounded sample: nodes with their statistics, the sample's spacing and the neighbours in reach.

    Points are shuffled once, by sample; everything else happens inside the row, for many samples at once. Samples with
    points that cannot be measured take column expressions.
    """
    packed = points.groupBy("sample_id").agg(F.collect_list(F.struct("id", "x", "y", "score")).alias("p")).where("size(p) >= 2")

    def measured(p: Column) -> Column:
        def one(a: Column) -> Column:
            def facts(near: Column) -> Column:
                first = F.slice(near, 1, NEAR)
                total = F.aggregate(first, F.lit(0.0), lambda acc, n: acc + n["d"])
                return F.struct(
                    a["id"].alias("id"), a["x"].alias("x"), a["y"].alias("y"), a["score"].alias("score"),
                    F.get(near, F.lit(0))["d"].alias("nearest"), (total / F.greatest(F.size(first), F.lit(1))).alias("mean3"), near.alias("near"),
                )

            return let(_near_of(a, p), facts)

        return F.transform(p, one)

    def finished(nodes: Column) -> Column:
        def with_spacing(space: Column) -> Column:
            def node(n: Column) -> Column:
                within = lambda factor: F.size(F.filter(n["near"], lambda m: m["d"] <= space * factor))
                reach = F.filter(n["near"], lambda m, i: (m["d"] <= space * radius_multiplier) | (i < k))
                return F.struct(
                    n["id"].alias("id"), n["x"].alias("x"), n["y"].alias("y"), n["score"].alias("score"), n["nearest"].alias("nearest"),
                    n["mean3"].alias("mean3"), space.alias("spacing"), within(RING_1).alias("ring1"), within(RING_2).alias("ring2"), F.size(n["near"]).alias("others"),
                    F.transform(reach, lambda m: m["j"]).alias("reach"),
                )

            return F.transform(nodes, node)

        return let(let(F.array_sort(F.transform(nodes, lambda n: n["nearest"])), _fenced_median), with_spacing)

    types = {f.name: f.dataType.simpleString() for f in points.schema}
    kind = "array<struct<" + ",".join(f"{c}:{types[c]}" for c in ("id", "x", "y", "score")) + f",nearest:double,mean3:double,spacing:double,ring1:int,ring2:int,others:int,reach:array<{types['id']}>>>"
    listed = to_arrow_type(_parse_datatype_string(kind))

    def many(p: pa.Array) -> pa.Array:
        return feature_arrays.nodes(p, listed, NEAR, (RING_1, RING_2), radius_multiplier, k)

    whole = packed.select("sample_id", F.array_sort("p").alias("p"))
    whole = whole.select("sample_id", "p", F.arrow_udf(many, kind)("p").alias("whole"))
    odd = F.when(F.col("whole").isNull(), F.col("p"))
    return whole.select("sample_id", F.coalesce("whole", F.when(F.col("whole").isNull(), let(let(odd, measured), finished))).alias("nodes"))


NODE_STATS = ("nearest", "mean3", "spacing", "ring1", "ring2", "others")


def _small_graph(points: DataFrame, radius_multiplier: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, neighbour pairs) of bounded samples."""
    rows = sample_rows(points, radius_multiplier, k)
    each = rows.select("sample_id", F.inline("nodes"))
    return each.select("sample_id", "id", *NODE_STATS), each.select("sample_id", F.col("id").alias("i"), F.explode("reach").alias("j"))


def _large_graph(points: DataFrame, radius_multiplier: float, k: int) -> tuple[DataFrame, DataFrame]:
    points = materialize(points, "points")
    near = materialize(nearest_tiled(points, max(k, NEAR)), "near")
    stats = nearest_stats(near)
    sizes = points.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    space = materialize(spacing_large(stats), "spacing")
    reach = max(radius_multiplier, RING_2)
    wide = materialize(pairs_within(points, space.select("sample_id", (F.col("spacing") * reach).alias("radius"))), "radius")
    wide = wide.join(space, "sample_id")
    rings = wide.groupBy("sample_id", "i").agg(
        F.count_if(F.col("d") <= F.col("spacing") * RING_1).cast("int").alias("ring1"),
        F.count_if(F.col("d") <= F.col("spacing") * RING_2).cast("int").alias("ring2"),
    )
    nodes = stats.join(rings, ["sample_id", "i"], "left").fillna(0, ["ring1", "ring2"]).join(space, "sample_id").join(sizes, "sample_id")
    nodes = nodes.select("sample_id", F.col("i").alias("id"), "nearest", "mean3", "spacing", "ring1", "ring2", (F.col("n") - 1).alias("others"))
    close = wide.where(F.col("d") <= F.col("spacing") * radius_multiplier).select("sample_id", "i", "j")
    return nodes, close.unionByName(near.where(F.col("rank") <= k).select("sample_id", "i", "j"))


def neighbour_graph(points: DataFrame, k: int = 8, radius_multiplier: float = 2.5, limit: int = PAIR_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(node statistics, ordered neighbour pairs) of all samples with at least two points."""
    small, large = split_hot(points, ["sample_id"], limit)
    nodes, pairs = _small_graph(small, radius_multiplier, k)
    if large is None:
        return nodes, pairs
    more_nodes, more_pairs = _large_graph(large, radius_multiplier, k)
    return nodes.unionByName(more_nodes), pairs.unionByName(more_pairs)


def known_edges(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct links (sample_id, u, v) whose two ends exist; self-loops and unreadable ends ignored."""
    ends = edges.where("src is not null and dst is not null and src <> dst")
    links = ends.select("sample_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    ids = lambda name: points.select("sample_id", F.col("id").alias(name))
    return links.join(ids("u"), ["sample_id", "u"], "left_semi").join(ids("v"), ["sample_id", "v"], "left_semi")


def candidate_edges(pairs: DataFrame, truth: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """(sample_id, u, v, label): neighbour pairs and truth links, each once. Without truth all labels are 0.

    Pass `points` when neighbours may be empty (k = 0): samples without any candidate then get the chain of
    consecutive points.
    """
    near = pairs.select("sample_id", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), F.lit(0).alias("label"))
    if truth is not None:
        near = near.unionByName(truth.select("sample_id", "u", "v", F.lit(1).alias("label")))
    out = near.groupBy("sample_id", "u", "v").agg(F.max("label").alias("label"))
    if points is None:
        return out
    bare = points.join(out.select("sample_id").distinct(), "sample_id", "left_anti").where("id > 0")
    return out.unionByName(bare.select("sample_id", (F.col("id") - 1).alias("u"), F.col("id").alias("v"), F.lit(0).alias("label")))


def node_features(points: DataFrame, nodes: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The eight node features. `sizes` may name (sample_id, width, height); the default side is 256."""
    return _feature_columns(points.select("sample_id", "id", "x", "y", "score").join(nodes, ["sample_id", "id"]), sizes)


def _feature_columns(full: DataFrame, sizes: DataFrame | None) -> DataFrame:
    full = full.join(sizes, "sample_id", "left") if sizes is not None else full.withColumn("width", F.lit(DEFAULT_SIDE)).withColumn("height", F.lit(DEFAULT_SIDE))
    side = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(DEFAULT_SIDE)), F.lit(1))
    gap = F.greatest("spacing", F.lit(1e-6))
    others = F.greatest("others", F.lit(1))
    return full.select(
        "sample_id", "id", "x", "y", "score", "spacing", side("width").alias("width"), side("height").alias("height"),
        (F.col("x") / side("width")).alias("f_x"), (F.col("y") / side("height")).alias("f_y"), F.col("score").alias("f_score"),
        (F.col("nearest") / gap).alias("f_nearest"), (F.col("mean3") / gap).alias("f_mean3"),
        (F.col("ring1") / others).alias("f_ring1"), (F.col("ring2") / others).alias("f_ring2"),
        (F.col("others") / others).alias("f_valid"),
    )


def edge_features(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ten link features of the candidates; `nodes` comes from `node_features`."""
    end = lambda s: nodes.select(
        "sample_id", F.col("id").alias(s), F.struct("x", "y", "score", F.col("f_ring1").alias("ring1")).alias(f"n{s}"),
        *(["spacing", "width", "height"] if s == "u" else []),
    )
    return _link_columns(candidates.join(end("u"), ["sample_id", "u"]).join(end("v"), ["sample_id", "v"]))


def _link_columns(both: DataFrame) -> DataFrame:
    """Features from rows with u, v, label, the end structs nu / nv (x, y, score, ring1 share), spacing, width, height."""
    a, b = F.col("nu"), F.col("nv")
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    gap = F.greatest("spacing", F.lit(1e-6))
    return both.select(
        "sample_id", "u", "v", "label",
        (dx / gap).alias("e_dx"), (dy / gap).alias("e_dy"), (F.sqrt(dx * dx + dy * dy) / gap).alias("e_d"),
        (F.abs(dx) / F.col("width")).alias("e_abs_dx"), (F.abs(dy) / F.col("height")).alias("e_abs_dy"),
        a["score"].alias("e_score_u"), b["score"].alias("e_score_v"), F.abs(a["score"] - b["score"]).alias("e_score_gap"),
        a["ring1"].alias("e_ring1_u"), b["ring1"].alias("e_ring1_v"),
    )


def _small_edge_features(rows: DataFrame, edges: DataFrame | None, sizes: DataFrame | None) -> DataFrame:
    """Candidates and their features straight from `sample_rows`: the ends are looked up in the row, nothing is joined.

    Ids are dense, so a truth link is known exactly when both ends are below the number of nodes.
    """
    key = lambda a, b: F.least(a, b).cast("long") * 4294967296 + F.greatest(a, b)
    if edges is not None:
        proper = edges.where("src is not null and dst is not null and src <> dst and least(src, dst) >= 0")
        truth = proper.groupBy("sample_id").agg(F.collect_set(key(F.col("src"), F.col("dst"))).alias("truth"))
        rows = rows.join(truth, "sample_id", "left")
        n = F.size("nodes")
        rows = rows.withColumn("truth", F.filter(F.coalesce("truth", F.expr("cast(array() as array<bigint>)")), lambda t: t % 4294967296 < n))
    else:
        rows = rows.withColumn("truth", F.expr("cast(array() as array<bigint>)"))
    rows = rows.join(sizes, "sample_id", "left") if sizes is not None else rows.withColumn("width", F.lit(DEFAULT_SIDE)).withColumn("height", F.lit(DEFAULT_SIDE))
    side = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(DEFAULT_SIDE)), F.lit(1)).alias(c)
    near = F.flatten(F.transform("nodes", lambda a: F.transform(a["reach"], lambda j: key(a["id"], j))))
    listed = rows.select("sample_id", side("width"), side("height"), "nodes", "truth", F.explode(F.array_distinct(F.concat(near, "truth"))).alias("key"))
    u, v = F.shiftright("key", 32).cast("int"), (F.col("key") % 4294967296).cast("int")
    end = lambda i: let(F.get("nodes", i), lambda m: F.struct(m["x"].alias("x"), m["y"].alias("y"), m["score"].alias("score"), (m["ring1"] / F.greatest(m["others"], F.lit(1))).alias("ring1")))
    ends = listed.select(
        "sample_id", F.get("nodes", F.lit(0))["spacing"].alias("spacing"), "width", "height", u.alias("u"), v.alias("v"), F.array_contains("truth", F.col("key")).cast("int").alias("label"),
        end(u).alias("nu"), end(v).alias("nv"),
    )
    return _link_columns(ends)


def graph_features(
    points: DataFrame, edges: DataFrame | None = None, sizes: DataFrame | None = None, k: int = 8,
    radius_multiplier: float = 2.5, limit: int = PAIR_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """(node features, link features) of a corpus. Samples with fewer than two points drop out."""
    small, large = split_hot(points, ["sample_id"], limit)
    if k <= 0:
        return _joined_features(points, edges, sizes, *neighbour_graph(points, k, radius_multiplier, limit), k)
    rows = sample_rows(small, radius_multiplier, k)
    bounded = edges
    if large is not None and edges is not None:
        names = materialize(large.select("sample_id").distinct(), "large")
        bounded, edges = edges.join(names, "sample_id", "left_anti"), edges.join(names, "sample_id", "left_semi")
    each = rows.select("sample_id", F.inline("nodes")).drop("reach")
    nodes, links = _feature_columns(each, sizes), _small_edge_features(rows, bounded, sizes)
    if large is None:
        return nodes, links
    more_nodes, more_links = _joined_features(large, edges, sizes, *_large_graph(large, radius_multiplier, k), k)
    return nodes.unionByName(more_nodes), links.unionByName(more_links)


def _joined_features(points, edges, sizes, stats: DataFrame, pairs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    truth = known_edges(points, edges) if edges is not None else None
    features = materialize(node_features(points, stats, sizes), "nodes")
    return features, edge_features(candidate_edges(pairs, truth, points if k <= 0 else None), features)


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: samples, average nodes and links, positives, negatives, positive share."""
    n = nodes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("label").alias("n_pos"))
    total = n.join(e, "sample_id").agg(
        F.count(F.lit(1)).alias("num_samples"), F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("nodes"),
        F.coalesce(F.sum("n_edges"), F.lit(0)).alias("edges"), F.coalesce(F.sum("n_pos"), F.lit(0)).alias("pos_edges"),
    )
    share = lambda c: F.when(F.col("num_samples") == 0, 0.0).otherwise(F.col(c) / F.col("num_samples"))
    return total.select(
        "num_samples", share("nodes").alias("avg_nodes"), share("edges").alias("avg_edges"), "pos_edges",
        (F.col("edges") - F.col("pos_edges")).alias("neg_edges"),
        (F.col("pos_edges") / F.greatest("edges", F.lit(1))).alias("pos_ratio"),
    )


def class_weight(edges: DataFrame) -> DataFrame:
    """max(negatives, 1) / max(positives, 1)."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return edges.agg((F.greatest(neg, F.lit(1)) / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def validation_count(n: int, ratio: float, kind: str = "edges") -> int:
    """Size of the validation part. Link model: rounded, at least one, never all. Point model: truncated, at least one."""
    if kind == "edges":
        return min(max(1, round(n * ratio)), n - 1) if n > 1 else n
    return max(1, math.trunc(n * ratio))


def split_samples(samples: DataFrame, ratio: float = 0.2, seed: int = 42, kind: str = "edges") -> DataFrame:
    """Add `part` ('train' / 'val') to distinct samples, with the exact validation count.

    Samples are ranked by a seeded 32-bit digest through running totals, so no single task ranks the corpus. One sample
    alone belongs to both parts in the link model and is labelled 'both'.
    """
    n = samples.count()
    if kind == "edges" and n <= 1:
        return samples.withColumn("part", F.lit("both"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("sample_id").cast("string")))
    hashed = samples.withColumn("__h", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") - 2147483648).cast("int"))
    ranked = running(hashed, [], "__h", [("__r", "sum", F.lit(1), True)], ["sample_id"])
    cut = validation_count(n, ratio, kind)
    return ranked.select(*samples.columns, F.when(F.col("__r") <= cut, "val").otherwise("train").alias("part"))


def link_strips(points: DataFrame, edges: DataFrame, space: DataFrame) -> DataFrame:
    """Oriented strip around each link: centre, unit vector, half sides and three corners, all as columns."""
    end = lambda s: points.select("sample_id", F.col("id").alias(s), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}"))
    j = edges.join(end("u"), ["sample_id", "u"]).join(end("v"), ["sample_id", "v"]).join(space, "sample_id")
    dx, dy = F.col("x_v") - F.col("x_u"), F.col("y_v") - F.col("y_u")
    size = F.sqrt(dx * dx + dy * dy)
    gap = F.greatest("spacing", F.lit(1.0))
    j = j.select(
        "sample_id", "u", "v", ((F.col("x_u") + F.col("x_v")) * 0.5).alias("cx"), ((F.col("y_u") + F.col("y_v")) * 0.5).alias("cy"),
        dx.alias("dx"), dy.alias("dy"), F.when(size < 1e-6, 1.0).otherwise(size).alias("length"), gap.alias("gap"),
    )
    j = j.select(
        "sample_id", "u", "v", "cx", "cy", (F.col("dx") / F.col("length")).alias("ux"), (F.col("dy") / F.col("length")).alias("uy"),
        (0.5 * (F.col("length") + F.col("gap"))).alias("half_len"), (0.75 * F.col("gap")).alias("half_w"),
    )
    ux, uy, hl, hw = (F.col(c) for c in ("ux", "uy", "half_len", "half_w"))
    return j.select(
        "*",
        (F.col("cx") - hl * ux + hw * uy).alias("x0"), (F.col("cy") - hl * uy - hw * ux).alias("y0"),
        (F.col("cx") + hl * ux + hw * uy).alias("x1"), (F.col("cy") + hl * uy - hw * ux).alias("y1"),
        (F.col("cx") - hl * ux - hw * uy).alias("x2"), (F.col("cy") - hl * uy + hw * ux).alias("y2"),
    )
