"""Image header, size, crop and strip queries on images derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from annograph import bridge
from annograph.catalog.graph import normal_form
from annograph.catalog.planning import sizes
from annograph.catalog.registry import query, with_ctes
from annograph.operators import corpus as C, graph as G
from annograph.plans.session import materialize, shared_dir
from annograph.sinks.writers import versioned_path
from annograph.sources import images as I
from annograph.sources.pixels import with_png, write_binary
from annograph.sources.roi_config import collect_rois


def _hex(value, digits: int):
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def header_files(spark, d):
    """PNG and JPEG heads with the planned sizes; JPEG heads carry an orientation tag."""
    p = bridge.table(spark, d, "part").select("p_partkey").join(
        sizes(spark, d).withColumn("p_partkey", F.regexp_extract("path", r"(\d+)", 1).cast("long")), "p_partkey"
    )
    w, h, k = F.col("width"), F.col("height"), F.col("p_partkey")
    colour = F.element_at(F.array(*[F.lit(c) for c in ("00", "02", "04", "06")]), (k % 4 + 1).cast("int"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 8), _hex(h, 8), F.lit("08"), colour, F.lit("000000"))
    tiff = F.concat(F.lit("49492A0008000000" "0100" "1201" "0300" "01000000"), _hex(k % 9, 2), F.lit("000000" "00000000"))
    jpeg = F.concat(F.lit("FFD8" "FFE1" "0022" "457869660000"), tiff, F.lit("FFC0" "0011" "08"), _hex(h, 4), _hex(w, 4), F.lit("03011100021101031101FFD9"))
    return p.select("p_partkey", "path", F.unhex(F.when(k % 2 == 0, png).otherwise(jpeg)).alias("content"))


@query("s7_image_headers", with_ctes("""SELECT p_partkey, 100 + p_size * 13 AS width, 80 + (p_partkey % 50) * 11 AS height,
  CASE WHEN p_partkey % 2 = 1 THEN 3 ELSE CASE p_partkey % 4 WHEN 0 THEN 1 ELSE 2 END END AS channels FROM part"""))
def image_headers(spark, d):
    return I.image_headers(header_files(spark, d)).select("p_partkey", "width", "height", "channels")


@query("s8_exif_orientation", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 9 ELSE 0 END AS orientation FROM part")
def exif_orientation(spark, d):
    return I.image_headers(header_files(spark, d)).select("p_partkey", "orientation")


PIXEL_SIZES = "CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 16 END"


def small_images(spark, d):
    """One-channel pixels of every embedding: 64 bytes laid out as 8x8, 16 high 4 wide, or 4 high 16 wide."""
    e = bridge.table(spark, d, "embeddings")
    width = F.element_at(F.array(F.lit(8), F.lit(4), F.lit(16)), (F.col("vec_id") % 3 + 1).cast("int"))
    byte = lambda v: F.lpad(F.hex((F.floor(F.abs(v) * 1000) % 256).cast("long")), 2, "0")
    data = F.unhex(F.array_join(F.transform("embedding", byte), ""))
    return e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), "vec_id", (64 / width).cast("int").alias("height"),
                    width.alias("width"), F.lit(1).alias("channels"), data.alias("data"), (F.col("vec_id") % 9).cast("int").alias("orientation"))


@query("s6_image_sizes", f"SELECT 'v' || vec_id || '.png' AS name, {PIXEL_SIZES} AS width, 64 // {PIXEL_SIZES} AS height FROM embeddings")
def image_sizes(spark, d):
    """PNG files written by the executors, decoded again by the image source."""
    out = versioned_path(f"{shared_dir(spark)}/annograph/png")
    write_binary(with_png(small_images(spark, d)), out, "path")
    return I.image_sizes(spark, out).select(F.concat("stem", "suffix").alias("name"), "width", "height")


BYTES = "px AS (SELECT vec_id, n - 1 AS n, CAST(floor(abs(CAST(embedding[n] AS DOUBLE)) * 1000) AS BIGINT) % 256 AS b, " + PIXEL_SIZES + " AS w FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS n FROM embeddings))"


@query("g6_crop_pixels", with_ctes("SELECT vec_id, sum(b) AS total, count(*) AS n FROM px WHERE n % w >= 1 AND n % w < 4 AND n // w >= 1 AND n // w < 3 GROUP BY 1", BYTES))
def crop_pixels(spark, d):
    """A 3 by 2 region of every image without turning it."""
    whole = small_images(spark, d).withColumn("orientation", F.lit(1))
    plan = whole.select("path", F.col("path").alias("out_name"), F.lit(1).alias("x"), F.lit(1).alias("y"), F.lit(3).alias("w"), F.lit(2).alias("h"))
    crops = I.crop_pixels(whole, plan)
    chars = F.filter(F.split(F.hex("data"), "(?<=\\G..)"), lambda c: c != "")
    total = F.aggregate(F.transform(chars, lambda c: F.conv(c, 16, 10).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return crops.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("vec_id"), total.alias("total"), (F.col("height") * F.col("width")).alias("n"))


@query("g6_oriented_tiles", with_ctes("""SELECT vec_id, count(*) AS tiles FROM (SELECT vec_id, CASE WHEN vec_id % 9 >= 5 THEN 64 // w ELSE w END AS iw, CASE WHEN vec_id % 9 >= 5 THEN w ELSE 64 // w END AS ih FROM (SELECT vec_id, """ + PIXEL_SIZES + """ AS w FROM embeddings)),
  LATERAL (SELECT unnest(range(CAST(ceil(iw / 4) AS INTEGER) * CAST(ceil(ih / 4) AS INTEGER)))) GROUP BY 1"""))
def oriented_tiles(spark, d):
    """Tiles of the turned images, as PNG bytes."""
    whole = small_images(spark, d)
    turned = F.col("orientation") >= 5
    seen = whole.select("path", F.when(turned, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(turned, F.col("width")).otherwise(F.col("height")).alias("height"))
    plan = C.tile_plan(seen, 4, 4)
    crops = with_png(I.crop_pixels(whole, plan)).where(F.length("content") > 0)
    return crops.groupBy(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("vec_id")).agg(F.count(F.lit(1)).alias("tiles"))


@query("g9_strip_pixels")
def strip_pixels(spark, d):
    """Pixel strips along every link of every sample, on an image per sample made from its points."""
    n = normal_form(spark, d)
    space = G.neighbour_graph(n.points)[0].select("sample_id", "spacing").distinct()
    strips = G.link_strips(n.points, n.edges.select("sample_id", F.col("src").alias("u"), F.col("dst").alias("v")), space)
    strips = materialize(strips.withColumn("path", F.col("sample_id").cast("string")), "strips")
    pixels = materialize(strips.select("path").distinct(), "paths").withColumn("data", F.unhex(F.repeat(F.md5("path"), 12)))
    images = pixels.select("path", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"), "data")
    out = I.strip_pixels(images, strips, 24, 6)
    return out.select("path", "u", "v", F.size("patch").alias("values"), F.round(F.array_max("patch"), 4).alias("brightest"))


@query("s10_roi_fields", with_ctes("""SELECT event_id, path, side, multi, CAST(roi_no AS INTEGER) AS roi_no, CAST(x1 AS INTEGER) AS x1 FROM (
  SELECT event_id, 'cams.0.top.ROI' AS path, 'top' AS side, false AS multi, 1 AS roi_no, user_id % 50 AS x1 FROM events
  UNION ALL SELECT event_id, 'cams.1.bottom.rois', 'bottom', true, 1, 1 FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT event_id, 'cams.1.bottom.rois', 'bottom', true, 2, event_id % 40 FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT event_id, 'deep.roi', 'unknown', false, 1, 9 FROM events) WHERE event_id % 10 <> 7"""))
def roi_fields(spark, d):
    """Rectangles of one nested configuration per event; some texts are broken, some lists are empty or hold three numbers."""
    e = bridge.table(spark, d, "events").select("event_id", "user_id")
    k = F.col("event_id")
    text = F.concat(
        F.lit('{"cams":[{"top":{"ROI":['), (F.col("user_id") % 50).cast("string"), F.lit(',2,60.5,70]}},{"bottom":{"rois":'),
        F.when(k % 3 == 0, "[]").otherwise(F.concat(F.lit("[[1,2,3,4],["), (k % 40).cast("string"), F.lit(",6,7,8]]"))),
        F.lit('}}],"bad":{"roi":[1,2,3]},"deep":{"roi":[9,8,7,6]}'), F.when(k % 10 == 7, "").otherwise("}"),
    )
    return collect_rois(e.select("event_id", text.alias("raw"))).select("event_id", "path", "side", "multi", "roi_no", "x1")


@query("ud2_roi_sides", with_ctes("SELECT 'top' AS side, count(*) AS n FROM events WHERE event_id % 10 <> 7 UNION ALL SELECT 'bottom', 2 * count(*) FROM events WHERE event_id % 10 <> 7 AND event_id % 3 <> 0 UNION ALL SELECT 'unknown', count(*) FROM events WHERE event_id % 10 <> 7"))
def roi_sides(spark, d):
    return roi_fields(spark, d).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


