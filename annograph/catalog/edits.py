"""Edit log and review merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from annograph import bridge
from annograph.catalog.graph import normal_form
from annograph.catalog.registry import NORMALIZED, query, r6, with_ctes
from annograph.catalog.validation import tables
from annograph.operators import edits as E, normalize as N
from annograph.plans.session import materialize


def plain_edges(n):
    return n.edges.select("sample_id", F.col("src").alias("u"), F.col("dst").alias("v"), (F.substring("edge_id", 6, 20).cast("int")).alias("pos"))


@query("e1_add_points", with_ctes("""SELECT sample_id, id, x, y, round(score, 6) AS score, 'manual' AS source FROM pts
  UNION ALL SELECT sample_id, CAST(coalesce(top, -1) + row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS INTEGER), x + 1, y + 1, 1.0, 'manual' FROM raw_points LEFT JOIN (SELECT sample_id, max(id) AS top FROM pts GROUP BY 1) USING (sample_id) WHERE id % 3 = 0""", *NORMALIZED))
def add_points(spark, d):
    raw, _ = tables(spark, d)
    added = raw.where("id % 3 = 0").select("sample_id", F.col("pos").alias("seq"), (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"))
    return E.add_points(normal_form(spark, d).points, added).withColumn("score", r6("score"))


TOGGLED = """flips AS (SELECT sample_id, least(src, dst) AS u, greatest(src, dst) AS v FROM raw_edges WHERE src <> dst GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
toggled AS (SELECT coalesce(e.sample_id, f.sample_id) AS sample_id, coalesce(e.u, f.u) AS u, coalesce(e.v, f.v) AS v, CASE WHEN e.u IS NULL THEN 'manual' ELSE 'kept' END AS origin
  FROM eds e FULL JOIN flips f ON e.sample_id = f.sample_id AND e.u = f.u AND e.v = f.v WHERE e.u IS NULL OR f.u IS NULL)"""


@query("e2_toggle_edges", with_ctes("SELECT sample_id, u, v, origin FROM toggled", *NORMALIZED, TOGGLED))
def toggle_edges(spark, d):
    _, raw = tables(spark, d)
    return E.toggle_edges(plain_edges(normal_form(spark, d)), raw.where("src <> dst"))


@query("u4_symmetric_toggle", with_ctes("SELECT sample_id, u, v FROM (SELECT sample_id, u, v FROM eds EXCEPT SELECT sample_id, u, v FROM flips) UNION ALL SELECT sample_id, u, v FROM (SELECT sample_id, u, v FROM flips EXCEPT SELECT sample_id, u, v FROM eds)", *NORMALIZED, TOGGLED))
def symmetric_toggle(spark, d):
    _, raw = tables(spark, d)
    return E.toggle_edges(plain_edges(normal_form(spark, d)), raw.where("src <> dst")).drop("origin")


def deleted(spark, d):
    raw, _ = tables(spark, d)
    return raw.where("pos % 4 = 1").select("sample_id", F.col("pos").alias("id"))


@query("e3_delete_points", with_ctes("""SELECT sample_id, 'point' AS kind, id AS a, id AS b FROM pts WHERE id % 4 <> 1
  UNION ALL SELECT sample_id, 'edge', u, v FROM eds WHERE u % 4 <> 1 AND v % 4 <> 1""", *NORMALIZED))
def delete_points(spark, d):
    n = normal_form(spark, d)
    points, edges = E.delete_points(n.points, plain_edges(n), deleted(spark, d))
    rows = lambda t, kind, a, b: t.select("sample_id", F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    return rows(points, "point", "id", "id").unionByName(rows(edges, "edge", "u", "v"))


@query("e4_move_points", with_ctes("""SELECT p.sample_id, p.id, coalesce(m.x, p.x) AS x, coalesce(m.y, p.y) AS y FROM pts p
  LEFT JOIN (SELECT sample_id, id, arg_max(x * 2, pos) AS x, arg_max(y + 3, pos) AS y FROM raw_points GROUP BY 1, 2) m ON m.sample_id = p.sample_id AND m.id = p.id""", *NORMALIZED))
def move_points(spark, d):
    raw, _ = tables(spark, d)
    moves = raw.select("sample_id", "id", F.col("pos").alias("seq"), (F.col("x") * 2).alias("x"), (F.col("y") + 3).alias("y"))
    return E.move_points(normal_form(spark, d).points, moves).select("sample_id", "id", "x", "y")


@query("e4_clear_edges", with_ctes("SELECT sample_id, u, v FROM eds JOIN orders ON o_orderkey = sample_id WHERE o_orderstatus <> 'F'", *NORMALIZED))
def clear_edges(spark, d):
    cleared = bridge.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("sample_id"))
    return E.clear_edges(plain_edges(normal_form(spark, d)), cleared).select("sample_id", "u", "v")


@query("e4_undo_last_edge", with_ctes("SELECT sample_id, u, v FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) AS r FROM eds) JOIN orders ON o_orderkey = sample_id WHERE r > 1 OR o_orderkey % 2 <> 0", *NORMALIZED))
def undo_last_edge(spark, d):
    undone = bridge.table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("sample_id"))
    return E.undo_last_edge(plain_edges(normal_form(spark, d)), undone).select("sample_id", "u", "v")


@query("e5_review_stamp", with_ctes("""SELECT p.sample_id, '{"source":"img_tools_point_edge_editor","origin_json":"ann/' || p.sample_id || '.json","point_count":' || n || ',"edge_count":' || coalesce(m, 0) || '}' AS links_stamp,
  '{"source":"img_tools_stitch_point_editor","conf":0.3,"point_count":' || n || '}' AS points_stamp
  FROM (SELECT sample_id, count(*) AS n FROM pts GROUP BY 1) p LEFT JOIN (SELECT sample_id, count(*) AS m FROM eds GROUP BY 1) e USING (sample_id)""", *NORMALIZED))
def review_stamp(spark, d):
    sizes = N.document_rows(*tables(spark, d)).select("sample_id", F.size("points").alias("n"), F.size("edges").alias("m"))
    origin = F.concat(F.lit("ann/"), F.col("sample_id").cast("string"), F.lit(".json"))
    return sizes.select(
        "sample_id", F.to_json(E.review_metadata("links", F.col("n"), F.col("m"), origin_json=origin)).alias("links_stamp"),
        F.to_json(E.review_metadata("points", F.col("n"), conf=F.lit(0.3))).alias("points_stamp"),
    )


def review_documents(spark, d):
    """(outputs, sources): normalised documents of the samples, which of them have an output, a source, and points or links in it."""
    docs = materialize(N.document_rows(*tables(spark, d)), "normalized")
    k, name = F.col("sample_id"), F.col("sample_id").cast("string")
    nothing = F.slice("edges", 1, 0)
    out = docs.where("sample_id % 2 = 0").select(
        "sample_id", F.when(k % 3 == 0, F.slice("points", 1, 0)).otherwise(F.col("points")).alias("points"), F.when(k % 5 < 2, nothing).otherwise(F.col("edges")).alias("edges"),
        F.lit(300).alias("width"), F.lit(200).alias("height"), F.concat(F.lit("out/"), name, F.lit(".json")).alias("json_path"),
    )
    src = docs.where("sample_id % 7 <> 0").select(
        "sample_id", "points", "edges", F.lit(128).alias("width"), F.lit(64).alias("height"), (k % 4 == 1).alias("legacy"), F.concat(F.lit("src/"), name, F.lit(".json")).alias("json_path"),
    )
    return out, src


REVIEW = """n AS (SELECT p.sample_id, np, coalesce(ne, 0) AS ne FROM (SELECT sample_id, count(*) AS np FROM pts GROUP BY 1) p LEFT JOIN (SELECT sample_id, count(*) AS ne FROM eds GROUP BY 1) USING (sample_id)),
outs AS (SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN 0 ELSE np END AS np, CASE WHEN sample_id % 5 < 2 THEN 0 ELSE ne END AS ne FROM n WHERE sample_id % 2 = 0),
srcs AS (SELECT sample_id, np, ne FROM n WHERE sample_id % 7 <> 0)"""


@query("j15_merge_annotations", with_ctes("""SELECT o.sample_id, CASE WHEN o.np = 0 AND s.np > 0 THEN s.np ELSE o.np END AS point_count, CASE WHEN o.ne = 0 AND s.ne > 0 THEN s.ne ELSE o.ne END AS edge_count,
  CASE WHEN o.np = 0 AND s.np > 0 THEN 'source' ELSE 'base' END AS points_from, CASE WHEN o.ne = 0 AND s.ne > 0 THEN 'source' ELSE 'base' END AS edges_from,
  CASE WHEN s.sample_id IS NOT NULL THEN 'src/' || o.sample_id || '.json' END AS merged_source_json FROM outs o LEFT JOIN srcs s USING (sample_id)""", *NORMALIZED, REVIEW))
def merge_annotations(spark, d):
    merged = E.merge_annotations(*review_documents(spark, d))
    return merged.withColumn("point_count", F.size("points")).withColumn("edge_count", F.size("edges")).drop("points", "edges")


@query("j16_load_precedence", with_ctes("""SELECT i.o_orderkey AS sample_id, CASE WHEN o.sample_id IS NOT NULL AND s.sample_id IS NOT NULL THEN 'output+source' WHEN o.sample_id IS NOT NULL THEN 'output' WHEN s.sample_id IS NULL THEN 'empty'
    WHEN s.sample_id % 4 = 1 THEN 'legacy source' ELSE 'source' END AS origin,
  CASE WHEN o.sample_id IS NOT NULL AND (o.np > 0 OR coalesce(s.np, 0) = 0) THEN o.np ELSE coalesce(s.np, 0) END AS point_count, CASE WHEN o.sample_id IS NOT NULL AND (o.ne > 0 OR coalesce(s.ne, 0) = 0) THEN o.ne ELSE coalesce(s.ne, 0) END AS edge_count,
  CASE WHEN o.sample_id IS NOT NULL THEN 300 WHEN s.sample_id IS NOT NULL THEN 128 ELSE 77 END AS width FROM orders i LEFT JOIN outs o ON o.sample_id = i.o_orderkey LEFT JOIN srcs s ON s.sample_id = i.o_orderkey""", *NORMALIZED, REVIEW))
def load_precedence(spark, d):
    images = bridge.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit(77).alias("image_width"), F.lit(55).alias("image_height"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return E.load_precedence(images, *review_documents(spark, d)).select("sample_id", "origin", size("points").alias("point_count"), size("edges").alias("edge_count"), "width")


@query("j18_nearest_point", with_ctes("""SELECT sample_id, click, id, round(d, 6) AS d FROM (SELECT q.sample_id, q.pos AS click, p.id, sqrt((p.x - q.y) * (p.x - q.y) + (p.y - q.x) * (p.y - q.x)) AS d,
  row_number() OVER (PARTITION BY q.sample_id, q.pos ORDER BY sqrt((p.x - q.y) * (p.x - q.y) + (p.y - q.x) * (p.y - q.x)), p.id) AS r FROM raw_points q JOIN pts p USING (sample_id)) WHERE r = 1 AND d <= 40""", *NORMALIZED))
def nearest_point(spark, d):
    raw, _ = tables(spark, d)
    clicks = raw.select("sample_id", F.col("pos").alias("click"), F.col("y").alias("qx"), F.col("x").alias("qy"))
    return E.nearest_point(normal_form(spark, d).points, clicks, 40.0).withColumn("d", r6("d"))


@query("w3_renumbered_edges", with_ctes("SELECT sample_id, format('edge_{:04d}', row_number() OVER (PARTITION BY sample_id ORDER BY pos)) AS edge_id, u, v FROM eds WHERE u % 2 = 0", *NORMALIZED))
def renumbered_edges(spark, d):
    return E.edge_ids(plain_edges(normal_form(spark, d)).where("u % 2 = 0"))


