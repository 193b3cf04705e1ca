"""Model-assisted steps, link selection and scoring against truth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from annograph import bridge
from annograph.catalog.graph import normal_form
from annograph.catalog.planning import SIZES, sizes
from annograph.catalog.registry import BASE, ELEMENTS, NORMALIZED, RAW_EDGES, RAW_PRED, query, r6, with_ctes
from annograph.catalog.validation import tables
from annograph.operators import corpus as C, evaluate as E, predict as P
from annograph.plans.session import materialize, shared_dir
from annograph.schemas import POSTPROCESS_PRESETS
from annograph.sinks import writers

CLASSES = """p AS (SELECT DISTINCT sample_id, least(src, dst) AS u, greatest(src, dst) AS v FROM raw_pred WHERE src <> dst),
t AS (SELECT DISTINCT sample_id, least(src, dst) AS u, greatest(src, dst) AS v FROM raw_edges WHERE src <> dst),
cls AS MATERIALIZED (SELECT coalesce(p.sample_id, t.sample_id) AS sample_id, coalesce(p.u, t.u) AS u, coalesce(p.v, t.v) AS v,
  CASE WHEN p.u IS NULL THEN 'FN' WHEN t.u IS NULL THEN 'FP' ELSE 'TP' END AS class
  FROM p FULL JOIN t ON p.sample_id = t.sample_id AND p.u = t.u AND p.v = t.v)"""
COMPARED = (ELEMENTS, RAW_EDGES, RAW_PRED, CLASSES)
RATIOS = """round(tp / greatest(tp + fp, 1), 6) AS "precision", round(tp / greatest(tp + fn, 1), 6) AS recall,
  round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-8), 6) AS f1"""
COUNTS = "SELECT sample_id, count_if(class = 'TP') AS tp, count_if(class = 'FP') AS fp, count_if(class = 'FN') AS fn FROM cls GROUP BY 1"
METRICS = f"""SELECT o.sample_id, o.sample_id || '.json' AS json_name, tp + fn AS gt_edges, tp + fp AS pred_edges, tp, fp, fn, {RATIOS} FROM (
  SELECT o_orderkey AS sample_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM orders LEFT JOIN ({COUNTS}) c ON c.sample_id = o_orderkey) o"""


def compared(spark, d):
    rows = bridge.elements(spark, d)
    return bridge.edges_predicted(spark, d, rows), bridge.edges_raw(spark, d, rows)


def sample_metrics(spark, d):
    samples = bridge.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"))
    return E.edge_metrics(*compared(spark, d), samples)


def rounded(df):
    return df.select(*[r6(c) if c in ("precision", "recall", "f1", "accuracy") else c for c in df.columns])


@query("j13_edge_classes", with_ctes("SELECT sample_id, u, v, class FROM cls", *COMPARED))
def edge_classes(spark, d):
    return E.classify_edges(*compared(spark, d))


@query("u1_edge_classes_by_sets", with_ctes("SELECT sample_id, u, v, class FROM cls", *COMPARED))
def edge_classes_by_sets(spark, d):
    return E.edge_classes_by_sets(*compared(spark, d))


@query("a9_edge_metrics", with_ctes(METRICS, *COMPARED))
def edge_metrics(spark, d):
    return rounded(sample_metrics(spark, d))


TOTALS = f"SELECT count(*) AS evaluated_samples, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ({METRICS})"


@query("a10_corpus_metrics", with_ctes(f"SELECT *, {RATIOS} FROM ({TOTALS})", *COMPARED))
def corpus_metrics(spark, d):
    return rounded(E.corpus_metrics(sample_metrics(spark, d)))


@query("a10_run_counters", with_ctes(f"""SELECT h.*, s.*, {RATIOS} FROM (SELECT count(*) AS num_json, count_if(o_custkey % 101 <> 7 AND coalesce(n, 0) >= 2) AS saved_annotations, count_if(o_custkey % 101 <> 7 AND coalesce(n, 0) < 2) AS skipped_empty_points, count_if(o_custkey % 101 = 7) AS errors
  FROM orders LEFT JOIN (SELECT sample_id, count(*) AS n FROM el GROUP BY 1) ON sample_id = o_orderkey) h, ({TOTALS}) s""", *COMPARED))
def run_counters(spark, d):
    sizes_ = bridge.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("point_count"))
    orders = bridge.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % 101 != 7).alias("readable"))
    documents = orders.join(sizes_, "sample_id", "left").fillna(0, ["point_count"])
    return rounded(E.run_counters(documents, sample_metrics(spark, d)))


@query("k4_metrics_csv", with_ctes(METRICS, *COMPARED))
def metrics_csv(spark, d):
    """Written with a header in fixed order and read back."""
    out = writers.versioned_path(f"{shared_dir(spark)}/annograph/metrics")
    metrics = materialize(sample_metrics(spark, d), "metrics")
    if not writers.write_metrics_csv(metrics, out):
        return rounded(metrics)
    return rounded(spark.read.schema(metrics.schema).option("header", True).csv(out))


@query("k5_metrics_summary", with_ctes(f"SELECT *, {RATIOS} FROM ({TOTALS})", *COMPARED))
def metrics_summary(spark, d):
    out = writers.versioned_path(f"{shared_dir(spark)}/annograph/metrics")
    metrics = materialize(sample_metrics(spark, d), "metrics")
    if not writers.write_metrics_summary(metrics, out):
        return rounded(E.corpus_metrics(metrics))
    return rounded(spark.read.schema(E.corpus_metrics(metrics).schema).json(out))


@query("a11_logit_metrics", f"""SELECT round(accuracy, 6) AS accuracy, {RATIOS} FROM (SELECT count_if(hit AND pos) AS tp, count_if(hit AND NOT pos) AS fp, count_if(NOT hit AND pos) AS fn, avg(CASE WHEN hit = pos THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM (SELECT 1 / (1 + exp(-(l_quantity / 25 - 1))) >= 0.5 AS hit, l_returnflag = 'R' AS pos FROM lineitem))""")
def logit_metrics(spark, d):
    rows = bridge.table(spark, d, "lineitem").select((F.col("l_quantity") / 25 - 1).alias("logit"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return rounded(E.binary_metrics(rows))


@query("j14_edge_geometry", with_ctes("SELECT c.sample_id, c.u, c.v, class, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM cls c JOIN (SELECT sample_id * 65536 + id AS k, x, y FROM pts) a ON a.k = c.sample_id * 65536 + c.u JOIN (SELECT sample_id * 65536 + id AS k, x, y FROM pts) b ON b.k = c.sample_id * 65536 + c.v", *NORMALIZED, RAW_PRED, CLASSES))
def edge_geometry(spark, d):
    return E.edge_geometry(E.classify_edges(*compared(spark, d)), normal_form(spark, d).points)


# ---------------------------------------------------------------- selection


SCORED = """scored AS MATERIALIZED (SELECT sample_id, least(src, dst) AS u, greatest(src, dst) AS v, max(score) AS score FROM raw_pred WHERE src <> dst GROUP BY 1, 2, 3),
kept AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY u, v) AS n FROM scored WHERE score >= 0.95)"""


def scored_links(spark, d):
    pred = bridge.edges_predicted(spark, d).where("src <> dst")
    return pred.groupBy("sample_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max("score").alias("score"))


@query("p19_above_threshold", with_ctes("SELECT sample_id, format('pred_edge_{:04d}', n) AS edge_id, u AS src, v AS dst, round(score, 6) AS score, 1 AS label, 'gnn_predict' AS source FROM kept", ELEMENTS, RAW_PRED, SCORED))
def above_threshold(spark, d):
    return P.above_threshold(scored_links(spark, d), 0.95).drop("pos").withColumn("score", r6("score"))


GREEDY = """ordered AS MATERIALIZED (SELECT sample_id, u, v, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, u, v) AS k FROM scored),
walk AS (
  SELECT sample_id, k, u, v, score, true AS keep, [u, v] AS ends FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.sample_id, o.k, o.u, o.v, o.score, len(list_filter(w.ends, lambda e: e = o.u)) < 2 AND len(list_filter(w.ends, lambda e: e = o.v)) < 2,
    CASE WHEN len(list_filter(w.ends, lambda e: e = o.u)) < 2 AND len(list_filter(w.ends, lambda e: e = o.v)) < 2 THEN list_concat(w.ends, [o.u, o.v]) ELSE w.ends END
  FROM walk w JOIN ordered o ON o.sample_id = w.sample_id AND o.k = w.k + 1)"""


@query("m5_select_links_by_degree", with_ctes("SELECT sample_id, format('pred_edge_{:04d}', row_number() OVER (PARTITION BY sample_id ORDER BY k)) AS edge_id, u AS src, v AS dst, round(score, 6) AS score FROM walk WHERE keep", ELEMENTS, RAW_PRED, SCORED, GREEDY))
def select_links_by_degree(spark, d):
    """Degree limit alone: no straightness bonus, no cycle rule."""
    links = P.above_threshold(scored_links(spark, d), 0.0)
    out = P.select_links(links, None, max_degree=2, max_small_cycle_length=0, continuity_weight=0.0)
    return out.select("sample_id", "edge_id", "src", "dst", r6("score"))


@query("w8_links_by_component", with_ctes("SELECT sample_id, format('pred_edge_{:04d}', row_number() OVER (PARTITION BY sample_id ORDER BY k)) AS edge_id, u AS src, v AS dst, round(score, 6) AS score FROM walk WHERE keep", ELEMENTS, RAW_PRED, SCORED, GREEDY))
def links_by_component(spark, d):
    """The same selection per connected group, the form that large samples take, with the renumbering by score."""
    links = P.above_threshold(scored_links(spark, d), 0.0)
    out = P.select_links(links, None, limit=0, max_degree=2, max_small_cycle_length=0, continuity_weight=0.0)
    return out.select("sample_id", "edge_id", "src", "dst", r6("score"))


@query("m5_select_links")
def select_links(spark, d):
    """Full rules: degree limit, straightness bonus, short-cycle rejection."""
    points = normal_form(spark, d).points
    return P.select_links(P.above_threshold(scored_links(spark, d), 0.0), points).withColumn("score", r6("score"))


@query("p21_preset_links")
def preset_links(spark, d):
    """Kept links per preset over all samples."""
    links = materialize(P.above_threshold(scored_links(spark, d), 0.0), "links")
    points = normal_form(spark, d).points
    out = None
    for preset in POSTPROCESS_PRESETS:
        part = P.select_links(links, points, preset).groupBy("sample_id").agg(F.count(F.lit(1)).alias("kept")).withColumn("preset", F.lit(preset))
        out = part if out is None else out.unionByName(part)
    return out


@query("m4_predict_links")
def predict_links(spark, d):
    """Points to links: features, a column scorer, threshold 0.5, balanced selection."""
    points = normal_form(spark, d).points
    near = lambda edges, nodes: edges.withColumn("score", F.exp(-F.col("e_d") / 3) * (F.col("e_score_u") + F.col("e_score_v")) / 2)
    return P.predict_edges(points, near).withColumn("score", r6("score"))


@query("m6_straightness", with_ctes("""SELECT b.sample_id, b.id, round(CASE WHEN n1 < 1e-6 OR n2 < 1e-6 THEN 0.0 ELSE 0.5 * (1 - greatest(-1.0, least(1.0, dot / (n1 * n2)))) END, 6) + 0.0 AS bonus FROM (
  SELECT sample_id, id, sqrt((px - x) ** 2 + (py - y) ** 2) AS n1, sqrt((nx - x) ** 2 + (ny - y) ** 2) AS n2, (px - x) * (nx - x) + (py - y) * (ny - y) AS dot
  FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY sample_id ORDER BY id)) WHERE px IS NOT NULL AND nx IS NOT NULL) b""", *NORMALIZED))
def straightness(spark, d):
    """Bonus at every inner point of the chain of consecutive points."""
    points = normal_form(spark, d).points
    end = lambda shift, n: points.select("sample_id", (F.col("id") + shift).alias("id"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    j = points.join(end(1, 1), ["sample_id", "id"]).join(end(-1, 2), ["sample_id", "id"])
    return j.select("sample_id", "id", r6(P.straightness(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]), "bonus"))


@query("m6_continuity_bonus", with_ctes("""SELECT l.sample_id, l.node, l.other, round(CASE WHEN k.n = 1 AND n1 >= 1e-6 AND n2 >= 1e-6 THEN 0.5 * (1 - greatest(-1.0, least(1.0, dot / (n1 * n2)))) ELSE 0.0 END, 6) + 0.0 AS bonus FROM (
  SELECT sample_id, u AS node, v AS other FROM eds UNION ALL SELECT sample_id, v, u FROM eds) l
  LEFT JOIN (SELECT sample_id, node, count(DISTINCT near) AS n, min(near) AS near FROM (SELECT sample_id, u AS node, v AS near FROM eds WHERE (u + v) % 2 = 0 UNION ALL SELECT sample_id, v, u FROM eds WHERE (u + v) % 2 = 0) GROUP BY 1, 2) k USING (sample_id, node)
  LEFT JOIN pts a ON a.sample_id = l.sample_id AND a.id = l.node LEFT JOIN pts b ON b.sample_id = l.sample_id AND b.id = k.near LEFT JOIN pts c ON c.sample_id = l.sample_id AND c.id = l.other,
  LATERAL (SELECT sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS n1, sqrt((c.x - a.x) ** 2 + (c.y - a.y) ** 2) AS n2, (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) AS dot)""", *NORMALIZED))
def continuity_bonus(spark, d):
    n = normal_form(spark, d)
    links = n.edges.select("sample_id", F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))))
    kept = n.edges.where("(src + dst) % 2 = 0").select("sample_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    return P.continuity_bonus(links, kept, n.points).withColumn("bonus", r6("bonus"))


@query("m7_path_lengths", with_ctes("SELECT p.sample_id, 0 AS src, p.id AS dst, m.d AS path_len FROM pts p LEFT JOIN (SELECT sample_id, node, min(depth) AS d FROM steps GROUP BY 1, 2) m ON m.sample_id = p.sample_id AND m.node = p.id WHERE p.id > 0",
       *NORMALIZED, "both_ways AS MATERIALIZED (SELECT sample_id, u, v FROM eds UNION SELECT sample_id, v, u FROM eds)",
       "steps AS (SELECT DISTINCT sample_id, 0 AS node, 0 AS depth FROM pts UNION SELECT s.sample_id, b.v, s.depth + 1 FROM steps s JOIN both_ways b ON b.sample_id = s.sample_id AND b.u = s.node WHERE s.depth < 3)"))
def path_lengths(spark, d):
    n = normal_form(spark, d)
    asked = n.points.where("id > 0").select("sample_id", F.lit(0).alias("src"), F.col("id").alias("dst"))
    return P.path_lengths(n.edges.select("sample_id", F.col("src").alias("u"), F.col("dst").alias("v")), asked, 3)


# ---------------------------------------------------------------- points


def spots(spark, d):
    points, _ = tables(spark, d)
    return points.select(F.col("sample_id").alias("image_id"), F.col("pos").alias("idx"), "x", "y", "score")


@query("m3_merge_points")
def merge_points(spark, d):
    return P.merge_near_points(spots(spark, d), 60.0).withColumn("score", r6("score"))


@query("m3_merge_points_by_rounds")
def merge_points_by_rounds(spark, d):
    """Merging as joins on the pairs within reach, the form that large images take."""
    return P.merge_near_points(spots(spark, d), 60.0, limit=0).withColumn("score", r6("score"))


BEST = "SELECT sample_id AS image_id, idx, x, y, round(score, 6) AS score FROM (SELECT sample_id, pos AS idx, x, y, score, row_number() OVER (PARTITION BY sample_id, id % 3 ORDER BY score DESC, pos) AS r FROM raw_points) WHERE r = 1"


@query("w7_best_per_cluster", with_ctes(BEST, *BASE))
def best_per_cluster(spark, d):
    points, _ = tables(spark, d)
    grouped = points.select(F.col("sample_id").alias("image_id"), F.col("pos").alias("idx"), "x", "y", "score", (F.col("id") % 3).alias("cluster"))
    return P.best_per_cluster(grouped).withColumn("score", r6("score"))


@query("t3_extreme_points", with_ctes("SELECT sample_id, arg_max(pos, (score, -pos)) AS best_pos, arg_min(pos, (x, y, pos)) AS left_pos FROM raw_points GROUP BY 1", *BASE))
def extreme_points(spark, d):
    points, _ = tables(spark, d)
    return points.groupBy("sample_id").agg(
        F.max_by("pos", F.struct(F.col("score"), -F.col("pos"))).alias("best_pos"), F.min_by("pos", F.struct("x", "y", "pos")).alias("left_pos")
    )


@query("t2_first_predicted_links", with_ctes("SELECT sample_id, u AS src, v AS dst, n FROM kept WHERE n <= 20", ELEMENTS, RAW_PRED, SCORED))
def first_predicted_links(spark, d):
    """The first twenty listed links of each sample."""
    listed = P.above_threshold(scored_links(spark, d), 0.95)
    return listed.where("pos < 20").select("sample_id", "src", "dst", (F.col("pos") + 1).alias("n"))


@query("a17_detected_points", with_ctes("SELECT count(*) AS images, sum(n) AS points FROM (SELECT sample_id, count(*) AS n FROM raw_points WHERE score > 0.95 GROUP BY 1)", *BASE))
def detected_points(spark, d):
    found = spots(spark, d).where("score > 0.95").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return found.agg(F.count(F.lit(1)).alias("images"), F.sum("n").alias("points"))


WINDOWS = """wins AS (SELECT path, x0, y0, width, height, CAST(row_number() OVER (PARTITION BY path ORDER BY y0, x0) - 1 AS INTEGER) AS tile FROM (
  SELECT path, width, height, unnest(list_distinct(list_concat(range(0, greatest(1, width - 256 + 1), 192), [greatest(0, width - 256)]))) AS x0, y0 FROM (
  SELECT *, unnest(list_distinct(list_concat(range(0, greatest(1, height - 256 + 1), 192), [greatest(0, height - 256)]))) AS y0 FROM sizes)))"""


@query("j17_tile_points", with_ctes("SELECT path AS image_id, tile, CAST((l_partkey * 37) % 256 + x0 AS DOUBLE) AS x, CAST((l_suppkey * 53) % 256 + y0 AS DOUBLE) AS y FROM lineitem JOIN wins ON path = 'img/p' || l_partkey || '.png' AND tile = l_linenumber - 1 WHERE (l_partkey * 37) % 256 + x0 < width AND (l_suppkey * 53) % 256 + y0 < height", SIZES, WINDOWS))
def tile_points(spark, d):
    from pyspark.sql import Window as W

    s = sizes(spark, d)
    order = F.row_number().over(W.partitionBy("path").orderBy("y0", "x0")) - 1
    tiles = C.sliding_windows(s, 256, 192).withColumn("tile", order).join(s, "path").withColumnRenamed("path", "image_id")
    found = bridge.table(spark, d, "lineitem").select(
        F.concat(F.lit("img/p"), F.col("l_partkey").cast("string"), F.lit(".png")).alias("image_id"), (F.col("l_linenumber") - 1).alias("tile"),
        ((F.col("l_partkey") * 37) % 256).alias("x"), ((F.col("l_suppkey") * 53) % 256).alias("y"), F.lit(1.0).alias("score"),
    )
    return P.tile_points(found, tiles).select("image_id", "tile", "x", "y")


# ---------------------------------------------------------------- maps


MAPS = "pix AS MATERIALIZED (SELECT vec_id AS image_id, (n - 1) % 8 AS x, (n - 1) // 8 AS y, CAST(embedding[n] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS n FROM embeddings))"


def map_pixels(spark, d):
    maps = bridge.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("heatmap"))
    return P.heatmap_pixels(maps, 8)


@query("m2_peaks", with_ctes("SELECT image_id, x, y, round(v, 6) + 0.0 AS score FROM pix a WHERE v > 0.1 AND v = (SELECT max(b.v) FROM pix b WHERE b.image_id = a.image_id AND abs(b.x - a.x) <= 2 AND abs(b.y - a.y) <= 2)", MAPS))
def peaks(spark, d):
    return P.peaks(map_pixels(spark, d), 0.1).withColumn("score", r6("score"))


@query("m1_model_maps", "SELECT vec_id AS image_id, CAST(len(list_filter(embedding, lambda v: v >= 0.05)) AS DOUBLE) AS lit FROM embeddings")
def model_maps(spark, d):
    """A batch model on every image: here a step at 0.05."""

    def make():
        def predict(pixels):
            return (pixels >= np.float32(0.05)).astype(np.float32)

        return predict

    images = bridge.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("pixels"))
    scored = P.score_heatmaps(images, make, [64])
    return scored.select("image_id", F.aggregate("heatmap", F.lit(0.0), lambda a, b: a + b).alias("lit"))


@query("m1_predict_points", with_ctes("SELECT image_id, x, y, round(v, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS r FROM pix a WHERE v > 0.1 AND v = (SELECT max(b.v) FROM pix b WHERE b.image_id = a.image_id AND abs(b.x - a.x) <= 2 AND abs(b.y - a.y) <= 2)) WHERE r = 1", MAPS))
def predicted_points(spark, d):
    """Images to points with an identity model; the merge distance covers the whole 8 by 8 map, so one point stays."""

    def make():
        return lambda pixels: pixels.astype(np.float32)

    images = bridge.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("pixels"))
    return P.predict_points(images, make, [64], 8, 0.1, 15.0).select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), r6("score"))


@query("ud1_detector", "SELECT image_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM (SELECT doc_id AS image_id, ord(text) % 256 AS x, octet_length(encode(text)) % 256 AS y FROM documents) GROUP BY 1")
def detector(spark, d):
    """A user's detector on image bytes, built once per worker: here one point from the first character and the length."""

    def make():
        def detect(data: bytes):
            return [(ord(data.decode()[0]) % 256, len(data) % 256, 1.0)]

        return detect

    images = bridge.table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.encode("text", "utf-8").alias("content"))
    return P.run_detector(images, make).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("a18_augmentation_mean", with_ctes("""SELECT image_id, bx AS x, by_ AS y, round(avg(v), 6) + 0.0 AS v FROM (
  SELECT image_id, v + 0.01 * b AS v, CASE WHEN b IN (1, 3, 5) THEN 7 - x WHEN b = 4 THEN 7 - y WHEN b = 6 THEN y ELSE x END AS bx,
    CASE WHEN b IN (2, 3, 5) THEN 7 - y WHEN b = 4 THEN x WHEN b = 6 THEN 7 - x ELSE y END AS by_ FROM pix, (SELECT unnest(range(0, 7)) AS b)) GROUP BY 1, 2, 3""", MAPS))
def augmentation_mean(spark, d):
    branches = map_pixels(spark, d).withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("v", F.col("v") + 0.01 * F.col("branch"))
    return P.augmentation_mean(branches, 8).withColumn("v", r6("v"))


