"""Image-corpus planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from annograph import bridge
from annograph.catalog.registry import query, with_ctes
from annograph.functions.text import output_path, stem_of, suffix_of
from annograph.operators import corpus as C
from annograph.plans.session import shared_dir
from annograph.sinks import writers

KEYWORDS = ["EN", "fr", "doc_d", "zz"]

FILES = """files AS (SELECT doc_id, 'data/' || source || '/Doc_' || lang || '_' || doc_id || CASE doc_id % 9 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg'
  WHEN 3 THEN '.bmp' WHEN 4 THEN '.tif' WHEN 5 THEN '.tiff' WHEN 6 THEN '.webp' WHEN 7 THEN '.txt' ELSE '.e.v2.png' END AS path FROM documents),
parts AS (SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '\\.[^./]*$') AS suffix FROM files),
named AS (SELECT doc_id, path, suffix, substr(name, 1, length(name) - length(suffix)) AS stem FROM parts)"""
IMG = ".bmp .jpg .jpeg .png .tif .tiff .webp".split()
IS_IMAGE = "lower(suffix) IN (" + ", ".join(f"'{s}'" for s in IMG) + ")"


def files(spark, d):
    docs = bridge.table(spark, d, "documents").select("doc_id", "lang", "source")
    tails = F.array(*[F.lit(s) for s in (".PNG", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp", ".txt", ".e.v2.png")])
    tail = F.element_at(tails, (F.col("doc_id") % 9 + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.lit("data/"), "source", F.lit("/Doc_"), "lang", F.lit("_"), F.col("doc_id").cast("string"), tail).alias("path"))


def images(spark, d):
    return C.image_files(files(spark, d))


SIZES = """sizes AS (SELECT 'img/p' || p_partkey || '.png' AS path, 100 + p_size * 13 AS width, CAST(80 + (p_partkey % 50) * 11 AS INTEGER) AS height FROM part)"""


def sizes(spark, d):
    p = bridge.table(spark, d, "part")
    return p.select(
        F.concat(F.lit("img/p"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"),
        (100 + F.col("p_size") * 13).alias("width"), (80 + (F.col("p_partkey") % 50) * 11).cast("int").alias("height"),
    )


@query("s1_image_files", with_ctes(f"SELECT path, stem, suffix FROM named WHERE {IS_IMAGE}", FILES))
def image_files(spark, d):
    return images(spark, d).select("path", "stem", "suffix")


@query("s2_image_files_custom", with_ctes("SELECT path FROM named WHERE lower(suffix) IN ('.png', '.txt')", FILES))
def image_files_custom(spark, d):
    return C.image_files(files(spark, d), (".png", ".txt")).select("path")


@query("p1_stem_and_suffix", with_ctes("SELECT path, stem, suffix FROM named", FILES))
def stem_and_suffix(spark, d):
    return files(spark, d).select("path", stem_of(F.col("path")).alias("stem"), suffix_of(F.col("path")).alias("suffix"))


@query("k10_output_paths", with_ctes("SELECT path, 'out/x/' || stem || '_resized' || suffix AS same_type, 'out/x/' || stem || '.jpg' AS as_jpg FROM named", FILES))
def output_paths(spark, d):
    path = F.col("path")
    return files(spark, d).select("path", output_path(path, "out\\x", "_resized").alias("same_type"), output_path(path, "out/x", extension=".jpg").alias("as_jpg"))


LABELLED = """labelled AS (SELECT *, CASE WHEN contains(lower(stem), 'en') THEN 'EN' WHEN contains(lower(stem), 'fr') THEN 'fr'
  WHEN contains(lower(stem), 'doc_d') THEN 'doc_d' WHEN contains(lower(stem), 'zz') THEN 'zz' ELSE '_unsorted' END AS keyword FROM named WHERE """ + IS_IMAGE + ")"


@query("p18_keyword_split", with_ctes("SELECT path, keyword FROM labelled", FILES, LABELLED))
def keyword_split(spark, d):
    return C.keyword_split(images(spark, d), KEYWORDS).select("path", "keyword")


@query("a8_keyword_counts", with_ctes("SELECT k.keyword, count(l.path) AS n FROM (VALUES ('EN'), ('fr'), ('doc_d'), ('zz'), ('_unsorted')) k(keyword) LEFT JOIN labelled l USING (keyword) GROUP BY 1", FILES, LABELLED))
def keyword_counts(spark, d):
    return C.keyword_counts(images(spark, d), KEYWORDS)


@query("k9_classified_copies", with_ctes("SELECT path AS src, 'out/' || keyword || '/' || stem || suffix AS dst, keyword FROM labelled WHERE doc_id % 5 <> 0", FILES, LABELLED))
def classified_copies(spark, d):
    every = images(spark, d)
    done = C.classified_copies(every.where("doc_id % 5 = 0"), KEYWORDS, "out").select(F.col("dst").alias("path"))
    return C.classified_copies(every, KEYWORDS, "out", done)


HASHED = "hashed AS (SELECT md5(text) AS md5, 'doc_' || doc_id AS path FROM documents)"


def hashed(spark, d):
    docs = bridge.table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return C.content_hashes(docs)


@query("s9_content_hash", with_ctes("SELECT path, md5 FROM hashed", HASHED))
def content_hash(spark, d):
    return hashed(spark, d)


@query("s9_duplicate_content", with_ctes("SELECT md5, count(*) AS copies, min(path) AS keep_path FROM hashed GROUP BY 1 HAVING count(*) > 1", HASHED))
def duplicate_content(spark, d):
    return C.duplicate_groups(hashed(spark, d))


def _grid(overlap: bool) -> str:
    if overlap:
        x, y, w, h = "CASE WHEN c * 256 + 256 > width THEN greatest(0, width - 256) ELSE c * 256 END", "CASE WHEN r * 256 + 256 > height THEN greatest(0, height - 256) ELSE r * 256 END", "256", "256"
    else:
        x, y, w, h = "c * 256", "r * 256", "CASE WHEN width > c * 256 THEN least(256, width - c * 256) ELSE 256 END", "CASE WHEN height > r * 256 THEN least(256, height - r * 256) ELSE 256 END"
    return f"""grid AS (SELECT path, CAST({x} AS INTEGER) AS x, CAST({y} AS INTEGER) AS y, CAST({w} AS INTEGER) AS w, CAST({h} AS INTEGER) AS h, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col
  FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(width / 256) AS INTEGER)))) AS c FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(height / 256) AS INTEGER)))) AS r FROM sizes)))"""


PLAN = """SELECT path, x, y, w, h, "row", col, replace(regexp_extract(path, '[^/]*$'), '.png', '') || '_tile_' || "row" || '_' || col || '.png' AS out_name FROM grid WHERE w >= 256 AND h >= 256"""


@query("g1_tile_grid", with_ctes('SELECT path, x, y, w, h, "row", col FROM grid', SIZES, _grid(True)))
def tile_grid(spark, d):
    return C.tile_grid(sizes(spark, d), 256, 256)


@query("g1_tile_grid_cut", with_ctes('SELECT path, x, y, w, h, "row", col FROM grid', SIZES, _grid(False)))
def tile_grid_cut(spark, d):
    return C.tile_grid(sizes(spark, d), 256, 256, allow_overlap=False)


@query("g2_tile_plan", with_ctes(PLAN, SIZES, _grid(True)))
def tile_plan(spark, d):
    return C.tile_plan(sizes(spark, d), 256, 256)


@query("g2_tile_plan_cut", with_ctes(PLAN, SIZES, _grid(False)))
def tile_plan_cut(spark, d):
    return C.tile_plan(sizes(spark, d), 256, 256, allow_overlap=False)


@query("a14_tile_preview", with_ctes('SELECT path, count(*) AS tiles, max("row") + 1 AS rows, max(col) + 1 AS cols FROM grid GROUP BY 1', SIZES, _grid(True)))
def tile_preview(spark, d):
    return C.tile_preview(sizes(spark, d), 256, 256)


RECTS = [(10, 10, 50, 40), (33, 7, 95, 61), (200, 10, 260, 40)]
CROPS = """rects(roi_no, x1, y1, x2, y2) AS (VALUES (1, 10, 10, 50, 40), (2, 33, 7, 95, 61), (3, 200, 10, 260, 40)),
scaled AS (SELECT path, roi_no, greatest(0, CAST(round_even(x1 * (width / 128), 0) AS INTEGER)) AS x1, greatest(0, CAST(round_even(y1 * (height / 96), 0) AS INTEGER)) AS y1,
  least(width, CAST(round_even(x2 * (width / 128), 0) AS INTEGER)) AS x2, least(height, CAST(round_even(y2 * (height / 96), 0) AS INTEGER)) AS y2 FROM sizes CROSS JOIN rects),
crops AS (SELECT *, replace(regexp_extract(path, '[^/]*$'), '.png', '') || '_roi_' || roi_no || '.png' AS out_name FROM scaled WHERE x2 > x1 AND y2 > y1)"""


@query("g3_crop_plan", with_ctes("SELECT path, roi_no, x1, y1, x2, y2, out_name FROM crops", SIZES, CROPS))
def crop_plan(spark, d):
    return C.crop_plan(sizes(spark, d), RECTS, 128, 96)


@query("g4_crop_totals", with_ctes("SELECT count(*) AS crops, count(DISTINCT path) AS images FROM crops", SIZES, CROPS))
def crop_totals(spark, d):
    return C.crop_plan(sizes(spark, d), RECTS, 128, 96).agg(F.count(F.lit(1)).alias("crops"), F.countDistinct("path").alias("images"))


def _starts(side: str) -> str:
    return f"list_distinct(list_concat(range(0, greatest(1, {side} - 256 + 1), 192), [greatest(0, {side} - 256)]))"


@query("g5_sliding_windows", with_ctes(f"SELECT path, unnest({_starts('width')}) AS x0, y0 FROM (SELECT *, unnest({_starts('height')}) AS y0 FROM sizes)", SIZES))
def sliding_windows(spark, d):
    return C.sliding_windows(sizes(spark, d), 256, 192)


@query("g7_resize_plan", with_ctes("""SELECT path, 'scale' AS how, greatest(1, CAST(trunc(width * 0.37) AS INTEGER)) AS new_width, greatest(1, CAST(trunc(height * 0.37) AS INTEGER)) AS new_height FROM sizes
  UNION ALL SELECT path, 'box', greatest(1, CAST(trunc(width * least(120 / width, 90 / height)) AS INTEGER)), greatest(1, CAST(trunc(height * least(120 / width, 90 / height)) AS INTEGER)) FROM sizes
  UNION ALL SELECT path, 'stretch', 120, 90 FROM sizes
  UNION ALL SELECT path, 'width', 150, greatest(1, CAST(trunc(height * (150 / width)) AS INTEGER)) FROM sizes
  UNION ALL SELECT path, 'height', greatest(1, CAST(trunc(width * (75 / height)) AS INTEGER)), 75 FROM sizes
  UNION ALL SELECT path, 'none', width, height FROM sizes""", SIZES))
def resize_plan(spark, d):
    s = sizes(spark, d)
    forms = {"scale": {"scale": 0.37}, "box": {"width": 120, "height": 90}, "stretch": {"width": 120, "height": 90, "keep_aspect": False},
             "width": {"width": 150}, "height": {"height": 75}, "none": {"scale": -1.0}}
    out = None
    for how, arguments in forms.items():
        part = C.resize_plan(s, **arguments).select("path", F.lit(how).alias("how"), "new_width", "new_height")
        out = part if out is None else out.unionByName(part)
    return out


@query("k7_unique_names", with_ctes("""SELECT seq, name, CASE WHEN n = 0 THEN name ELSE replace(name, '.png', '') || '_' || n || '.png' END AS target FROM (
  SELECT i.seq, i.name, (SELECT f FROM (SELECT f, row_number() OVER (ORDER BY f) - 1 AS k FROM (SELECT unnest(range(0, 4000)) AS f)
     WHERE f NOT IN (SELECT t FROM (VALUES (0), (2), (3)) x(t) WHERE i.g % 2 = 0)) WHERE k = i.r) AS n
  FROM (SELECT doc_id AS seq, doc_id % 40 AS g, 'scan' || chr(CAST(97 + doc_id % 40 % 26 AS INTEGER)) || CASE WHEN doc_id % 40 < 26 THEN '' ELSE 'x' END || '.png' AS name,
        row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) - 1 AS r FROM documents) i)"""))
def unique_names(spark, d):
    """Many files of few names; every second name has the plain form and numbers 2 and 3 taken."""
    g = (F.col("doc_id") % 40).cast("int")
    name = F.concat(F.lit("scan"), F.char(97 + g % 26), F.when(g < 26, "").otherwise("x"), F.lit(".png"))
    incoming = bridge.table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("seq"), name.alias("name"), g.alias("g"))
    held = incoming.where("g % 2 = 0").select("name").distinct()
    stem = stem_of(F.col("name"))
    existing = held.select(F.explode(F.array(F.col("name"), F.concat(stem, F.lit("_2.png")), F.concat(stem, F.lit("_3.png")))).alias("name"))
    return C.unique_names(incoming, existing)


@query("k8_versioned_output", with_ctes("SELECT path, width, height FROM sizes", SIZES))
def versioned_output(spark, d):
    """Written to a new version and read back; earlier versions stay."""
    path = writers.write_versioned(sizes(spark, d), f"{shared_dir(spark)}/annograph/sizes")
    return spark.read.parquet(path).select("path", "width", "height")


