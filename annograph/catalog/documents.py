"""Queries over annotation documents as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from annograph import bridge
from annograph.catalog.planning import SIZES, sizes
from annograph.catalog.registry import ISSUES, NORMALIZED, query, with_ctes
from annograph.catalog.validation import FULL, STATS, annotation_files, image_facts, normalized_documents, tables
from annograph.functions import documents as D, json_text as J
from annograph.operators import export as X, normalize as N, validate as V
from annograph.plans.session import materialize, shared_dir
from annograph.sinks import writers
from annograph.sources import annotations as S


def _pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def event_documents(spark, d):
    """One document per event: broken text, wrong shapes, a list, the current dialect, and two-shape legacy documents."""
    e = bridge.table(spark, d, "events").select("event_id", "user_id", "event_type")
    k = F.col("event_id")

    def shape(s: int) -> Column:
        n = k + s
        x, y = ((F.col("user_id") * s) % 256).cast("string"), ((k * 7 + s) % 199).cast("string")
        return F.concat(
            F.lit('{"shape_type":"'), F.when(n % 3 == 0, "rectangle").otherwise("point"), F.lit('","label":"'),
            _pick(n % 5, "sew", "KeyPoint", " Sew ", "other", "sew"), F.lit('","points":'),
            F.when(n % 11 == 0, "[]").otherwise(F.concat(F.lit("[["), x, F.lit(","), y, F.lit("]]"))),
            _pick(n % 4, "", ',"score":null', ',"score":0', ',"score":0.5'), F.lit("}"),
        )

    legacy = F.concat(
        F.lit('{"imagePath":"a/b/img_'), k.cast("string"), F.lit('.png","imageWidth":'), F.when(k % 6 == 0, "0").otherwise("320"),
        F.lit(',"imageHeight":240,"shapes":['), shape(1), F.lit(",7,"), shape(2), F.lit("]}"),
    )
    current = F.concat(
        F.lit('{"sample_id":"s'), k.cast("string"), F.lit('","image_size":{"width":100},"points":[{"x":1,"y":2.5},{"id":7,"x":"3","y":4,"score":0.25}],"edges":[{"src":0,"dst":7},{"src":7,"dst":0},{"src":1}]}'),
    )
    kind = k % 10
    raw = F.when(kind == 0, '{"shapes":[').when(kind == 1, '{"shapes":5}').when(kind == 2, "[1,2]").when(kind == 3, current).otherwise(legacy)
    return e.select("event_id", "event_type", F.concat(F.lit("ann/e"), k.cast("string"), F.lit(".json")).alias("path"), F.concat(F.lit("e"), k.cast("string")).alias("stem"), raw.alias("raw"))


SHAPES = """shapes AS (SELECT event_id, event_type, s, event_id + s AS n, CAST((user_id * s) % 256 AS DOUBLE) AS x, CAST((event_id * 7 + s) % 199 AS DOUBLE) AS y
  FROM events, (VALUES (1), (2)) t(s) WHERE event_id % 10 >= 4),
shared AS (SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY s) - 1 AS INTEGER) AS id, x, y, CASE WHEN n % 4 = 3 THEN 0.5 ELSE 1.0 END AS score
  FROM shapes WHERE n % 3 <> 0 AND n % 5 <> 3 AND n % 11 <> 0),
strict AS (SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_id ORDER BY s) - 1 AS INTEGER) AS id, x, y,
  CASE n % 4 WHEN 3 THEN 0.5 WHEN 2 THEN 0.0 ELSE 1.0 END AS score FROM shapes WHERE n % 3 <> 0 AND n % 5 IN (0, 4) AND n % 11 <> 0)"""


@query("s5_parse_documents", "SELECT event_id, event_id % 10 <> 0 AS readable, event_id % 10 NOT IN (0, 2) AS is_object, event_id % 10 >= 4 AS legacy FROM events")
def parse_documents(spark, d):
    return S.parse_annotations(event_documents(spark, d)).select(F.substring("sample_id", 2, 20).cast("long").alias("event_id"), "readable", "is_object", "legacy")


@query("s5_parse_event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def parse_event_props(spark, d):
    return bridge.table(spark, d, "events").select("event_id", D.field(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("p3_dialect", "SELECT CASE WHEN event_id % 10 >= 4 THEN 'legacy' WHEN event_id % 10 IN (0, 2) THEN 'unusable' ELSE 'current' END AS dialect, count(*) AS n FROM events GROUP BY 1")
def dialect(spark, d):
    parsed = S.parse_annotations(event_documents(spark, d))
    kind = F.when(F.col("legacy"), "legacy").when(~F.col("readable") | ~F.col("is_object"), "unusable").otherwise("current")
    return parsed.groupBy(kind.alias("dialect")).agg(F.count(F.lit(1)).alias("n"))


def _exploded(spark, d, reading):
    docs = event_documents(spark, d).select("event_id", J.document(F.col("raw")).alias("doc"))
    return docs.select("event_id", F.inline(reading(F.col("doc")))).drop("source")


@query("p4_legacy_points", with_ctes("SELECT event_id, id, x, y, score FROM shared", SHAPES))
def legacy_points(spark, d):
    return _exploded(spark, d, D.legacy_points)


@query("p5_legacy_points_strict", with_ctes("SELECT event_id, id, x, y, score FROM strict", SHAPES))
def legacy_points_strict(spark, d):
    return _exploded(spark, d, D.legacy_points_strict)


@query("p2_empty_document", with_ctes("""SELECT path, '{"schema_version":"1.2","sample_id":"' || path || '","image_path":"' || path || '","image_size":{"width":' || width || ',"height":' || height || '},"roi":null,"spacing_hint":null,"points":[],"edges":[],"segments":[],"metadata":{}}' AS body FROM sizes""", SIZES))
def empty_document(spark, d):
    return sizes(spark, d).select("path", D.master_json(F.col("path"), F.col("path"), F.col("width"), F.col("height")).alias("body"))


@query("p6_legacy_to_current", with_ctes("""SELECT e.event_id, CASE WHEN e.event_id % 6 = 0 THEN 256 ELSE 320 END AS width, 240 AS height, 'a/b/img_' || e.event_id || '.png' AS image_path,
  '{"origin_format":"labelme","source":"labelme_point"}' AS metadata, count(s.id) AS point_count, coalesce(sum(s.score), 0.0) AS score_sum
  FROM events e LEFT JOIN shared s USING (event_id) WHERE e.event_id % 10 >= 4 GROUP BY ALL""", SHAPES))
def legacy_to_current(spark, d):
    docs = S.parse_annotations(event_documents(spark, d)).where("legacy")
    return docs.select(
        F.substring("sample_id", 2, 20).cast("long").alias("event_id"), "width", "height", "image_path", F.to_json("metadata").alias("metadata"),
        F.size("raw_points").alias("point_count"), F.aggregate(F.transform("raw_points", lambda p: p["score"]), F.lit(0.0), lambda a, b: a + b).alias("score_sum"),
    )


@query("p7_current_to_legacy", with_ctes("""SELECT e.event_id, '{"version":"5.0.1","flags":{},"shapes":[' || coalesce((SELECT string_agg('{"label":"sew","points":[[' || x || ',' || y || ']],"group_id":null,"description":"","shape_type":"point","flags":{},"score":' || CAST(score AS DOUBLE) || '}', ',' ORDER BY id) FROM shared s WHERE s.event_id = e.event_id), '')
  || '],"imagePath":"img_' || e.event_id || '.png","imageData":null,"imageHeight":240,"imageWidth":' || CASE WHEN e.event_id % 6 = 0 THEN 256 ELSE 320 END || '}' AS body FROM events e WHERE e.event_id % 10 >= 4""", SHAPES))
def current_to_legacy(spark, d):
    docs = N.normalize_rows(S.parse_annotations(event_documents(spark, d)).where("legacy"))
    body = D.legacy_json(F.col("image_path"), F.col("width"), F.col("height"), F.col("points"))
    return docs.select(F.substring("sample_id", 2, 20).cast("long").alias("event_id"), body.alias("body"))


def detections(spark, d):
    e = bridge.table(spark, d, "events").select("event_id", "user_id")
    point = lambda s: F.struct(((F.col("user_id") * s) % 256).cast("double").alias("x"), ((F.col("event_id") * 7 + s) % 199).cast("double").alias("y"), F.lit(0.5 * s).alias("score"))
    return e.select("event_id", F.concat(F.lit("a/b/img_"), F.col("event_id").cast("string"), F.lit(".png")).alias("image_path"), F.array(point(1), point(2)).alias("points"))


DETECTED = """det AS (SELECT event_id, s, CAST((user_id * s) % 256 AS DOUBLE) AS x, CAST((event_id * 7 + s) % 199 AS DOUBLE) AS y, CAST(0.5 * s AS DOUBLE) AS score FROM events, (VALUES (1), (2)) t(s))"""


@query("p8_detections_legacy", with_ctes("""SELECT event_id, '{"version":"3.3.9","flags":{},"shapes":[' || string_agg('{"label":"spot","score":' || score || ',"points":[[' || x || ',' || y || ']],"group_id":null,"description":"","difficult":false,"shape_type":"point","flags":{},"attributes":{},"kie_linking":[]}', ',' ORDER BY s)
  || '],"imagePath":"img_' || event_id || '.png","imageData":null,"imageHeight":240,"imageWidth":320}' AS body FROM det GROUP BY 1""", DETECTED))
def detections_legacy(spark, d):
    return detections(spark, d).select("event_id", D.detection_legacy_json(F.col("image_path"), F.lit(320), F.lit(240), F.col("points"), "spot").alias("body"))


@query("p9_detections_current", with_ctes("""SELECT event_id, '{"schema_version":"1.2","sample_id":"e' || event_id || '","image_path":"img_' || event_id || '.png","image_size":{"width":320,"height":240},"roi":null,"spacing_hint":null,"points":['
  || string_agg('{"id":' || (s - 1) || ',"x":' || x || ',"y":' || y || ',"score":' || score || ',"source":"model"}', ',' ORDER BY s) || '],"edges":[],"segments":[],"metadata":{"source":"sew_point_batch_infer","point_count":2,"model":"m1"}}' AS body FROM det GROUP BY 1""", DETECTED))
def detections_current(spark, d):
    name = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    body = D.detection_master_json(F.col("image_path"), F.lit(320), F.lit(240), F.col("points"), name, model=F.lit("m1"))
    return detections(spark, d).select("event_id", body.alias("body"))


@query("p10_point_schema", with_ctes("""SELECT CASE WHEN e.event_id % 10 = 3 THEN 's' ELSE 'e' END || e.event_id AS sample_id, 'e' || e.event_id || '.json' AS json_name, e.event_id % 10 = 3 AS current,
  CASE WHEN e.event_id % 10 = 3 THEN 100 WHEN e.event_id % 10 = 1 OR e.event_id % 6 = 0 THEN 256 ELSE 320 END AS width,
  CASE WHEN e.event_id % 10 = 3 THEN 2 ELSE (SELECT count(*) FROM strict s WHERE s.event_id = e.event_id) END AS point_count FROM events e WHERE e.event_id % 10 NOT IN (0, 2)""", SHAPES))
def point_schema(spark, d):
    return S.to_point_schema(event_documents(spark, d)).select("sample_id", "json_name", "current", "width", F.size("raw_points").alias("point_count"))


USABLE = """usable AS (SELECT e.event_type AS source, max(CASE WHEN e.event_id % 10 = 3 THEN 2 ELSE coalesce(n, 0) END) AS best
  FROM events e LEFT JOIN (SELECT event_id, count(*) AS n FROM strict GROUP BY 1) s USING (event_id) GROUP BY 1)"""


@query("p22_usable_sources", with_ctes("SELECT source, best FROM usable", SHAPES, USABLE))
def usable_sources(spark, d):
    return S.usable_sources(event_documents(spark, d).withColumnRenamed("event_type", "source"))


@query("p22_choose_source", with_ctes("""SELECT CASE WHEN b1 >= 2 THEN 'nowhere' WHEN b2 >= 2 THEN t ELSE 'nowhere' END AS chosen, b1 < 2 AND b2 >= 2 AS fell_back FROM (
  SELECT coalesce(max(CASE WHEN source = 'nowhere' THEN best END), 0) AS b1, coalesce(max(CASE WHEN source = 'click' THEN best END), 0) AS b2, 'click' AS t FROM usable)""", SHAPES, USABLE))
def choose_source(spark, d):
    return S.choose_source(S.usable_sources(event_documents(spark, d).withColumnRenamed("event_type", "source")), "nowhere", "click")


@query("p23_review_reading", with_ctes("""SELECT 'e' || e.event_id AS sample_id, e.event_id % 10 = 3 AS current, CASE WHEN e.event_id % 10 = 3 THEN 2 ELSE (SELECT count(*) FROM shared s WHERE s.event_id = e.event_id) END AS point_count,
  CASE WHEN e.event_id % 10 = 3 THEN 1 ELSE 0 END AS edge_count FROM events e WHERE e.event_id % 10 <> 0""", SHAPES))
def review_reading(spark, d):
    docs = N.normalize_documents(S.review_documents(event_documents(spark, d)))
    return docs.select("sample_id", "current", F.size("points").alias("point_count"), F.size("edges").alias("edge_count"))


@query("p13_json_documents", """SELECT 'e' || event_id AS sample_id, 3 AS issue_count FROM events WHERE false
  UNION ALL SELECT 'e' || event_id, CASE WHEN event_id % 10 = 3 THEN 3 WHEN event_id % 10 >= 4 THEN 0 ELSE 1 END FROM events WHERE event_id % 10 NOT IN (0, 2)""")
def json_documents(spark, d):
    """Issue counts straight from JSON text: a repeat, an unreadable link and a back-filled image path in current documents."""
    docs = S.parse_annotations(event_documents(spark, d)).where("readable and is_object")
    return N.normalize_rows(docs).select("sample_id", F.size("issues").alias("issue_count"))


@query("p13_json_round_trip", with_ctes("""SELECT CAST(sample_id AS VARCHAR) AS sample_id, CASE WHEN sample_id % 13 = 0 THEN sample_id || '.png' ELSE 'img/' || sample_id || '.png' END AS image_path, 256 AS width,
  point_count, edge_count, issue_count + CASE WHEN sample_id % 13 = 0 THEN 1 ELSE 0 END AS issue_count FROM stats""", *NORMALIZED, ISSUES, STATS))
def json_round_trip(spark, d):
    """Element tables to JSON text, parsed and normalised as whole documents."""
    docs = N.group_documents(*tables(spark, d))
    name = F.col("sample_id").cast("string")
    body = F.to_json(F.struct(
        F.when(F.col("sample_id") % 13 != 0, F.concat(F.lit("img/"), name, F.lit(".png"))).alias("image_path"),
        F.transform("raw_points", lambda p: p.dropFields("pos", "is_object")).alias("points"),
        F.transform("raw_edges", lambda e: e.dropFields("pos", "is_object", "edge_id")).alias("edges"),
    ))
    raw = docs.select(name.alias("path"), name.alias("stem"), body.alias("raw"))
    out = N.normalize_rows(S.parse_annotations(raw), "codes")
    return out.select("sample_id", "image_path", "width", F.size("points").alias("point_count"), F.size("edges").alias("edge_count"), F.size("issues").alias("issue_count"))


def _written(spark, d, kind: str):
    """Documents of the accepted samples."""
    docs, stats = normalized_documents(spark, d)
    docs = docs.withColumn("width", F.lit(256)).withColumn("height", F.lit(256))
    seen = materialize(V.inspect(image_facts(spark, d), stats.join(annotation_files(spark, d), "sample_id")), "inspected")
    return X.export_documents(docs, X.export_manifest(seen, kind, "out"), kind)


@query("k1_written_documents", with_ctes("SELECT 'out/annotations/' || sample_id || '.json' AS json_dst, point_count FROM insp WHERE state = 'INSPECTED' AND error_count = 0 AND point_count > 0", *FULL))
def written_documents(spark, d):
    """Accepted documents written as a dataset and read back."""
    out = f"{writers.versioned_path(shared_dir(spark) + '/annograph/documents')}"
    writers.write_annotations(_written(spark, d, "points"), out)
    body = J.document(F.col("body"))
    return spark.read.parquet(out).select("json_dst", F.size(D.array_at(body, "$.shapes")).alias("point_count"))


@query("k3_edge_documents", with_ctes("SELECT CAST(sample_id AS VARCHAR) AS sample_id, point_count, edge_count FROM insp WHERE state = 'INSPECTED' AND error_count = 0 AND point_count > 1 AND edge_count > 0", *FULL))
def edge_documents(spark, d):
    body = J.document(F.col("body"))
    return _written(spark, d, "edges").select(
        D.field(body, "$.sample_id", "string").alias("sample_id"), F.size(D.array_at(body, "$.points")).alias("point_count"), F.size(D.array_at(body, "$.edges")).alias("edge_count")
    )
