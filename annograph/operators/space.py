"""Neighbour searches in samples of any size and any spread: tiles of bounded counts, and leaves of bounded counts in them.

A sample of more than `TILE` points is cut into strips at quantiles of x and each strip at quantiles of y, so tiles hold
like numbers of points however these lie. Inside a tile, points are halved along their wider side until a leaf holds
`LEAF` of them, and a search goes through the leaves whose boxes are near enough. What a tile finds bounds the distance
to look at; only points with another tile's box within that bound are sent there. So neither an outlier nor a dense spot
makes a search compare all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from annograph.plans.groups import whole_groups
from annograph.plans.session import materialize
from annograph.plans.skew import hot_groups

TILE, LEAF = 20_000, 32
#: Quantiles that cuts are chosen from; a strip has at most so many tiles, a sample so many strips.
CUTS = 256
#: Pairs handed on at once.
PAIRS = 200_000

_KEY = ["sample_id", "tile"]


# ---------------------------------------------------------------- inside a tile


def leaves(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Indexes of the points in groups of at most `LEAF` near one another."""
    done, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        px, py = x[rows], y[rows]
        wide = px if np.ptp(px) >= np.ptp(py) else py
        half = len(rows) // 2
        split = np.argpartition(wide, half)
        open_ += [rows[split[:half]], rows[split[half:]]]
    return done


def _boxes(x: np.ndarray, y: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    return np.array([(x[g].min(), x[g].max(), y[g].min(), y[g].max()) for g in groups])


def _gaps(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Distance of a box to others; never more than that of any two points in them, also as rounded."""
    dx = np.maximum(np.maximum(boxes[:, 0] - box[1], box[0] - boxes[:, 1]), 0)
    dy = np.maximum(np.maximum(boxes[:, 2] - box[3], box[2] - boxes[:, 3]), 0)
    return np.sqrt(dx * dx + dy * dy)


class Leaves:
    """Points (x, y, id) of a tile, ready to be searched."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray):
        self.x, self.y, self.ids = x, y, ids
        self.groups = leaves(x, y)
        self.boxes = _boxes(x, y, self.groups)

    def _blocks(self, qx: np.ndarray, qy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries near one another, distance of their box to each leaf)."""
        groups = leaves(qx, qy)
        for rows, box in zip(groups, _boxes(qx, qy, groups)):
            yield rows, _gaps(box, self.boxes)

    def _measured(self, qx: np.ndarray, qy: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points of the chosen leaves by id, and their distances to each query."""
        rows = np.concatenate([self.groups[n] for n in chosen])
        rows = rows[np.argsort(self.ids[rows], kind="stable")]
        dx, dy = qx[:, None] - self.x[rows], qy[:, None] - self.y[rows]
        return rows, np.sqrt(dx * dx + dy * dy)

    def nearest(self, qx: np.ndarray, qy: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids (query x k) of the nearest points; of equal distances the lower ids. Missing ones: inf, -1."""
        gap, found = np.full((len(qx), k), np.inf), np.full((len(qx), k), -1, np.int64)
        sizes = np.array([len(g) for g in self.groups])
        for rows, far in self._blocks(qx, qy):
            by_gap = np.argsort(far, kind="stable")
            first = int(np.searchsorted(np.cumsum(sizes[by_gap]), 2 * k)) + 1
            chosen = by_gap[:first]
            points, d = self._measured(qx[rows], qy[rows], chosen)
            bound = np.partition(d, k - 1, axis=1)[:, k - 1].max() if d.shape[1] >= k else np.inf
            reached = by_gap[: int(np.searchsorted(far[by_gap], bound, side="right"))]
            if len(reached) > len(chosen):
                points, d = self._measured(qx[rows], qy[rows], reached)
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            n = order.shape[1]
            gap[rows, :n], found[rows, :n] = np.take_along_axis(d, order, 1), self.ids[points][order]
        return gap, found

    def within(self, qx: np.ndarray, qy: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, id, distance) of all pairs of a distance up to `radius`, some at a time."""
        for rows, far in self._blocks(qx, qy):
            chosen = np.flatnonzero(far <= radius)
            step = max(1, PAIRS // (LEAF * max(len(rows), 1)))
            for at in range(0, len(chosen), step):
                points, d = self._measured(qx[rows], qy[rows], chosen[at : at + step])
                q, p = np.nonzero(d <= radius)
                if len(q):
                    yield rows[q], self.ids[points[p]], d[q, p]


# ---------------------------------------------------------------- tiles


def _pieces(bounds: Column, value: Column, pieces: Column) -> Column:
    """Which of like-sized pieces a value falls in, by the quantiles of its group."""
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(pieces - 1, F.lit(1))), lambda i: F.get(bounds, F.floor(i * CUTS / pieces).cast("int") - 1)))
    return F.when(pieces <= 1, 0).otherwise(F.size(F.filter(chosen, lambda b: b < value)))


def tiled(points: DataFrame, tile: int = TILE) -> tuple[DataFrame, bool]:
    """`points` with `tile`, and whether any sample has more than one."""
    large = hot_groups(points, ["sample_id"], tile)
    if large is None:
        return points.withColumn("tile", F.lit(0)), False
    shares = [i / CUTS for i in range(1, CUTS)]
    pieces = lambda n: F.least(F.ceil(n), F.lit(CUTS)).cast("int")
    many = points.join(large, "sample_id", "left_semi")
    by_x = many.groupBy("sample_id").agg(F.percentile_approx("x", shares).alias("bx"), pieces(F.sqrt(F.count(F.lit(1)) / tile)).alias("nx"))
    strips = many.join(by_x, "sample_id").withColumn("strip", _pieces(F.col("bx"), F.col("x"), F.col("nx"))).drop("bx", "nx")
    strips = materialize(strips, "strips")
    by_y = strips.groupBy("sample_id", "strip").agg(F.percentile_approx("y", shares).alias("by"), pieces(F.count(F.lit(1)) / tile).alias("ny"))
    cut = strips.join(by_y, ["sample_id", "strip"]).withColumn("tile", F.col("strip") * CUTS + _pieces(F.col("by"), F.col("y"), F.col("ny")))
    rest = points.join(large, "sample_id", "left_anti").withColumn("tile", F.lit(0))
    return materialize(rest.unionByName(cut.select(*points.columns, "tile")), "tiles"), True


def _groups(batches, names: list[str]) -> Iterator[tuple[pa.Scalar, dict[str, np.ndarray]]]:
    """(sample, columns as numpy arrays) of rows that stand tile by tile."""
    held: list[pa.RecordBatch] = []

    def closed():
        whole = pa.Table.from_batches(held)
        return held[0].column("sample_id")[0], {n: whole.column(n).to_numpy() for n in names}

    for batch in batches:
        if not batch.num_rows:
            continue
        sample, tile = batch.column("sample_id"), batch.column("tile").to_numpy()
        codes = sample.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (tile[1:] != tile[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and (held[0].column("sample_id")[0] != sample[a] or held[0].column("tile")[0].as_py() != tile[a]):
                yield closed()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield closed()


def _abreast(group: np.ndarray, ids: np.ndarray, chosen: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (group, point in id order) of the chosen groups, equally large groups together."""
    order, sizes = np.lexsort((ids, group)), np.bincount(group)
    first = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[chosen]):
        same = np.flatnonzero(chosen & (sizes == n))
        for part in np.array_split(same, -(-len(same) * n * n // PAIRS)):
            yield order[first[part][:, None] + np.arange(n)]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(group, point, other point) of coordinates (group, point)."""
    dx, dy = x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :]
    return np.sqrt(dx * dx + dy * dy)


def _by_tile(rows: DataFrame, work, schema: str) -> DataFrame:
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(work, schema)


def _boxed(tiles: DataFrame) -> DataFrame:
    """(sample_id, boxes): the boxes of all tiles of a sample; one row for `TILE` points or so."""
    boxes = tiles.groupBy(*_KEY).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return boxes.groupBy("sample_id").agg(F.collect_list(F.struct("tile", "x0", "x1", "y0", "y1")).alias("boxes"))


def _sent(rows: DataFrame, boxes: DataFrame, bound: str) -> DataFrame:
    """Rows once for every other tile of the sample whose box is within `bound` of (x, y), with that tile as `tile`."""

    def reached(b: Column) -> Column:
        dx = F.greatest(b["x0"] - F.col("x"), F.col("x") - b["x1"], F.lit(0.0))
        dy = F.greatest(b["y0"] - F.col("y"), F.col("y") - b["y1"], F.lit(0.0))
        return (b["tile"] != F.col("tile")) & (F.sqrt(dx * dx + dy * dy) <= F.col(bound))

    other = F.transform(F.filter("boxes", reached), lambda b: b["tile"])
    return rows.join(boxes, "sample_id").withColumn("to", F.explode(other)).drop("boxes", "tile").withColumnRenamed("to", "tile")


def _sample_type(df: DataFrame) -> tuple[str, pa.DataType]:
    kind = df.schema["sample_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def nearest_tiled(points: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """The k nearest neighbours (sample_id, i, j, d, rank) of every point; equal distances go to the lower index.

    Points at one spot are interchangeable but for their index, so a spot is asked for once and offers its k + 1 lowest
    indices only. Points without finite coordinates have no neighbours and are none.
    """
    finite = points.select("sample_id", F.col("id").cast("bigint").alias("id"), "x", "y").where("abs(x) < double('inf') and abs(y) < double('inf')")
    spot = W.partitionBy("sample_id", "x", "y").orderBy("id")
    offered = finite.withColumn("r", F.row_number().over(spot)).where(F.col("r") <= k + 1).drop("r")
    tiles, several = tiled(offered, tile)
    named, kind = _sample_type(points)
    entry = pa.struct([("d", pa.float64()), ("j", pa.int64())])

    def lists(sample: pa.Scalar, x: np.ndarray, y: np.ndarray, at: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        d, j = found
        there = j >= 0
        near = pa.StructArray.from_arrays([pa.array(d[there]), pa.array(j[there])], fields=list(entry))
        offsets = pa.array(np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array([sample.as_py()] * len(x), kind), pa.array(x), pa.array(y), pa.array(at), pa.ListArray.from_arrays(offsets, near)], names=["sample_id", "x", "y", "tile", "near"]
        )

    schema = f"sample_id {named}, x double, y double, tile int, near array<struct<d:double,j:bigint>>"

    def leaf_lists(names: pa.Array, c: dict[str, np.ndarray], at: np.ndarray) -> pa.RecordBatch:
        """The lists of groups of one leaf, one for each spot."""
        x, y, ids = c["x"][at], c["y"][at], c["id"][at]
        d = _distances(x, y)
        near = np.argsort(d, axis=2, kind="stable")[:, :, : k + 1]
        spot = np.tril((x[:, :, None] == x[:, None, :]) & (y[:, :, None] == y[:, None, :]), -1)
        g, p = np.nonzero(~spot.any(2))
        some, there = np.take_along_axis(d, near, 2)[g, p], ids[g[:, None], near[g, p]]
        entries = pa.StructArray.from_arrays([pa.array(some.ravel()), pa.array(there.ravel())], fields=list(entry))
        found = pa.ListArray.from_arrays(pa.array((np.arange(len(g) + 1) * near.shape[2]).astype(np.int32)), entries)
        row = at[g, p]
        return pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(c["x"][row]), pa.array(c["y"][row]), pa.array(c["tile"][row].astype(np.int32)), found], names=["sample_id", "x", "y", "tile", "near"])

    def inside(batches):
        for rows, group in whole_groups(batches, _KEY):
            small = np.bincount(group) <= LEAF
            c = {n: rows.column(n).to_numpy() for n in ("tile", "x", "y", "id")}
            for at in _abreast(group, c["id"], small):
                yield leaf_lists(rows.column("sample_id").combine_chunks(), c, at)
            yield from searched(rows.filter(pa.array(~small[group])).to_batches())

    def searched(batches):
        for sample, c in _groups(batches, ["tile", "x", "y", "id"]):
            spots = np.unique(np.stack([c["x"], c["y"]]), axis=1)
            yield lists(sample, *spots, np.full(spots.shape[1], c["tile"][0], np.int32), Leaves(c["x"], c["y"], c["id"]).nearest(*spots, k + 1))

    known = _by_tile(tiles, inside, schema)
    if several:
        known = materialize(known, "near")
        boxes = materialize(_boxed(tiles), "boxes")
        last = F.when(F.size("near") == k + 1, F.get(F.col("near"), F.lit(k))["d"]).otherwise(float("inf"))
        asked = materialize(_sent(known.withColumn("bound", last), boxes, "bound").select("sample_id", "tile", "x", "y", F.lit(None).cast("bigint").alias("id")), "asked")

        def across(batches):
            for sample, c in _groups(batches, ["tile", "x", "y", "id"]):
                query = np.isnan(c["id"].astype(np.float64))
                if query.any():
                    held = Leaves(c["x"][~query], c["y"][~query], c["id"][~query].astype(np.int64))
                    qx, qy = c["x"][query], c["y"][query]
                    yield lists(sample, qx, qy, np.full(len(qx), -1, np.int32), held.nearest(qx, qy, k + 1))

        targets = tiles.join(asked.select(*_KEY).distinct(), _KEY, "left_semi")
        more = _by_tile(targets.select("sample_id", "tile", "x", "y", "id").unionByName(asked), across, schema)
        found = known.unionByName(more).groupBy("sample_id", "x", "y").agg(F.flatten(F.collect_list("near")).alias("near"))
        known = found.withColumn("near", F.slice(F.array_sort("near"), 1, k + 1))
    own = finite.select("sample_id", F.col("id").alias("i"), "x", "y").join(known.drop("tile"), ["sample_id", "x", "y"])
    others = F.slice(F.filter("near", lambda n: n["j"] != F.col("i")), 1, k)
    each = own.select("sample_id", "i", F.posexplode(others).alias("r", "n"))
    like = points.schema["id"].dataType
    return each.select("sample_id", F.col("i").cast(like).alias("i"), F.col("n.j").cast(like).alias("j"), F.col("n.d").alias("d"), (F.col("r") + 1).alias("rank"))


def pairs_within(points: DataFrame, radius: DataFrame, tile: int = TILE) -> DataFrame:
    """Ordered pairs (sample_id, i, j, d) with d <= radius of the sample (sample_id, radius), which may be infinite."""
    finite = points.select("sample_id", F.col("id").cast("bigint").alias("id"), "x", "y").where("abs(x) < double('inf') and abs(y) < double('inf')")
    tiles, several = tiled(finite, tile)
    reach = tiles.join(radius, "sample_id").select(*_KEY, "x", "y", "id", F.col("radius").cast("double").alias("radius"), F.lit(True).alias("here"))
    rows = reach
    if several:
        away = _sent(reach, materialize(_boxed(tiles), "boxes"), "radius").withColumn("here", F.lit(False))
        rows = reach.unionByName(away)
    named, kind = _sample_type(points)

    def work(batches):
        for rows, group in whole_groups(batches, _KEY):
            c = {n: rows.column(n).to_numpy() for n in ("x", "y", "id", "radius", "here")}
            small = np.bincount(group) <= LEAF
            small[group[~c["here"].astype(bool)]] = False
            for at in _abreast(group, c["id"], small):
                i, d = c["id"][at], _distances(c["x"][at], c["y"][at])
                g, a, b = np.nonzero((d <= c["radius"][at[:, 0]][:, None, None]) & (i[:, :, None] != i[:, None, :]))
                names_ = rows.column("sample_id").combine_chunks().take(pa.array(at[g, 0]))
                yield pa.RecordBatch.from_arrays([names_, pa.array(i[g, a]), pa.array(i[g, b]), pa.array(d[g, a, b])], names=["sample_id", "i", "j", "d"])
            yield from searched(rows.filter(pa.array(~small[group])).to_batches())

    def searched(batches):
        for sample, c in _groups(batches, ["tile", "x", "y", "id", "radius", "here"]):
            here = c["here"].astype(bool)
            held = Leaves(c["x"][here], c["y"][here], c["id"][here])
            for q, j, d in held.within(c["x"], c["y"], float(c["radius"][0])):
                i = c["id"][q]
                other = i != j
                yield pa.RecordBatch.from_arrays([pa.array([sample.as_py()] * int(other.sum()), kind), pa.array(i[other]), pa.array(j[other]), pa.array(d[other])], names=["sample_id", "i", "j", "d"])

    found = _by_tile(rows, work, f"sample_id {named}, i bigint, j bigint, d double")
    like = points.schema["id"].dataType
    return found.select("sample_id", F.col("i").cast(like).alias("i"), F.col("j").cast(like).alias("j"), "d")
