"""Seeded expansion of point sets and heat-map targets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from annograph.plans.groups import whole_groups


def uniform(seed: int, name: str) -> Column:
    """Number in [0, 1) fixed by (sample, copy, seed, name)."""
    text = F.concat_ws(":", F.col("sample_id").cast("string"), F.col("copy").cast("string"), F.lit(str(seed)), F.lit(name))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def expand_samples(samples: DataFrame, copies: int = 6, seed: int = 42) -> DataFrame:
    """(sample_id, copy, width, height, transform parameters): one row per copy, reproducible on every run."""
    u = lambda name: uniform(seed, name)
    whole = lambda name, top: F.floor(u(name) * (top + 1)).cast("int")
    each = samples.select("sample_id", "width", "height", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    on = lambda name, level: u(name) > level
    each = each.select(
        "*",
        F.when(on("pad?", 0.5), 10 + whole("pad", F.lit(40))).otherwise(0).alias("pad"),
        F.radians(u("angle") * 360.0).alias("angle"), on("hflip?", 0.5).alias("hflip"), on("vflip?", 0.5).alias("vflip"),
        F.when(on("shift?", 0.3), (u("tx") * 0.4 - 0.2) * F.col("width")).otherwise(0.0).alias("tx"),
        F.when(on("shift?", 0.3), (u("ty") * 0.4 - 0.2) * F.col("height")).otherwise(0.0).alias("ty"),
        F.when(on("scale?", 0.3), 0.8 + u("scale") * 0.4).otherwise(1.0).alias("scale"),
        F.when(on("crop?", 0.3), 0.7 + u("crop") * 0.3).otherwise(1.0).alias("crop"),
    )
    each = each.withColumn("cw", F.floor(F.col("width") * F.col("crop")).cast("int")).withColumn("ch", F.floor(F.col("height") * F.col("crop")).cast("int"))
    return each.select(
        "*", whole("padx", F.col("pad") * 2).alias("px"), whole("pady", F.col("pad") * 2).alias("py"),
        whole("cropx", F.col("width") - F.col("cw")).alias("cx0"), whole("cropy", F.col("height") - F.col("ch")).alias("cy0"),
    )


def augment_points(points: DataFrame, samples: DataFrame, copies: int = 6, seed: int = 42) -> DataFrame:
    """Points of every copy after pad+crop, turn, flips, shift, scale and crop-zoom; those outside the image drop out."""
    j = points.select("sample_id", "id", "x", "y").join(expand_samples(samples, copies, seed), "sample_id")
    w, h = F.col("width"), F.col("height")
    x, y, angle = F.col("x"), F.col("y"), F.col("angle")
    moved = lambda nx, ny: [nx.alias("x"), ny.alias("y")]
    rest = [c for c in j.columns if c not in ("x", "y")]
    j = j.select(*rest, *moved(x + F.col("pad") - F.col("px"), y + F.col("pad") - F.col("py")))
    cos, sin = F.cos(angle), F.sin(angle)
    j = j.select(*rest, *moved(cos * (x - w / 2) + sin * (y - h / 2) + w / 2, -sin * (x - w / 2) + cos * (y - h / 2) + h / 2))
    j = j.select(*rest, *moved(F.when(F.col("hflip"), w - 1 - x).otherwise(x), F.when(F.col("vflip"), h - 1 - y).otherwise(y)))
    j = j.select(*rest, *moved(x + F.col("tx"), y + F.col("ty")))
    j = j.select(*rest, *moved((x - w / 2) * F.col("scale") + w / 2, (y - h / 2) * F.col("scale") + h / 2))
    j = j.select(*rest, *moved((x - F.col("cx0")) * (w / F.col("cw")), (y - F.col("cy0")) * (h / F.col("ch"))))
    return j.where("x >= 0 and x < width and y >= 0 and y < height").select("sample_id", "copy", "id", "x", "y", "width", "height")


#: Side of the squares of pixels that are worked out at once; a square has at most as many centres as pixels in reach.
SQUARE = 128


def heatmap_targets(points: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Sparse target map (sample_id, x, y, v): the largest Gaussian stamp at each pixel, stamps clipped at the border.

    `points`: sample_id, x, y, width, height. Equal centres are stamped once. Centres travel to the squares that their
    stamps reach and are stamped there, so no pixel is shuffled. The largest stamp is that of the nearest centre.
    """
    half = int(6 * sigma + 1) // 2
    span = int(6 * sigma + 1)
    centres = points.select("sample_id", "width", "height", F.rint("x").cast("int").alias("px"), F.rint("y").cast("int").alias("py"))
    centres = centres.dropna(subset=["width", "height", "px", "py"]).distinct()

    def squares(at: str, side: str) -> Column:
        low, high = F.greatest(F.col(at).cast("long") - half, F.lit(0)), F.least(F.col(at).cast("long") + (span - half - 1), F.col(side).cast("long") - 1)
        return F.when(low <= high, F.sequence(F.floor(low / SQUARE), F.floor(high / SQUARE)))

    reached = centres.withColumn("sx", F.explode(squares("px", "width"))).withColumn("sy", F.explode(squares("py", "height")))
    key = ["sample_id", "sx", "sy"]
    dealt = reached.repartition(*key).sortWithinPartitions(*key)
    dx, dy = (g.ravel() for g in np.meshgrid(np.arange(-half, span - half), np.arange(-half, span - half)))
    gap = dx * dx + dy * dy
    top = int(gap.max()) + 1
    kind = points.schema["sample_id"].dataType
    schema = pa.schema([("sample_id", to_arrow_type(kind)), ("x", pa.int32()), ("y", pa.int32()), ("gap", pa.int32())])

    def stamped(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        """The pixels of whole squares: sorted by square, pixel and distance, the first of each pixel stays."""
        sx, sy, px, py, width, height = (rows.column(n).to_numpy() for n in ("sx", "sy", "px", "py", "width", "height"))
        x, y = px[:, None].astype(np.int64) + dx - (sx * SQUARE)[:, None], py[:, None].astype(np.int64) + dy - (sy * SQUARE)[:, None]
        right, low = np.minimum(width - sx * SQUARE, SQUARE), np.minimum(height - sy * SQUARE, SQUARE)
        inside = (x >= 0) & (x < right[:, None]) & (y >= 0) & (y < low[:, None])
        code = (((group[:, None] * SQUARE + y) * SQUARE + x) * top + gap)[inside]
        code.sort()
        pixel = code // top
        first = np.concatenate([[True], pixel[1:] != pixel[:-1]]) if len(pixel) else np.zeros(0, bool)
        code, pixel = code[first], pixel[first]
        at = np.searchsorted(group, pixel // (SQUARE * SQUARE))
        x, y = sx[at] * SQUARE + pixel % SQUARE, sy[at] * SQUARE + pixel // SQUARE % SQUARE
        arrays = [rows.column("sample_id").combine_chunks().take(pa.array(at)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array((code % top).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches):
        for rows, group in whole_groups(batches, key):
            yield stamped(rows, group)

    pixels = dealt.mapInArrow(run, f"sample_id {kind.simpleString()}, x int, y int, gap int")
    return pixels.select("sample_id", "x", "y", F.exp(-F.col("gap") / F.lit(2.0 * sigma * sigma)).alias("v"))

