"""Normalisation, validation, pairing and export queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from annograph import bridge
from annograph.catalog.registry import BASE, ELEMENTS, FOLD, ISSUES, NORM_EDGES, NORM_POINTS, NORMALIZED, RAW_POINTS, RAW_PRED, query, r6, with_ctes
from annograph.operators import export as X, normalize as N, pairing, validate as V
from annograph.plans.session import materialize
from annograph.sinks import writers


def tables(spark, d):
    rows = bridge.elements(spark, d)
    return bridge.points_raw(spark, d, rows), bridge.edges_raw(spark, d, rows)


def normalized(spark, d) -> N.Normalized:
    return N.normalize_tables(*tables(spark, d))


def large_names(large) -> DataFrame:
    return large[0].select("sample_id").unionByName(large[1].select("sample_id")).distinct()


def sample_stats(spark, d) -> DataFrame:
    """Counts per annotation, from document rows where they fit and from element rows where they do not."""
    docs, large = N.split_by_size(*tables(spark, d))
    stats = V.document_stats(N.normalize_documents(docs, "codes"))
    if large is not None:
        stats = stats.unionByName(V.table_stats(N.normalize_large(*large), large_names(large)))
    return stats


def normalized_documents(spark, d) -> tuple[DataFrame, DataFrame]:
    """(rows sample_id, points, edges; `sample_stats`) of one pass over the corpus, which is written in between."""
    docs, large = N.split_by_size(*tables(spark, d))
    docs = materialize(N.normalize_documents(docs, "codes").drop("raw_points", "raw_edges"), "normalized")
    rows, stats = docs.drop("issues"), V.document_stats(docs)
    if large is not None:
        rest, names = N.normalize_large(*large), large_names(large)
        rows = rows.unionByName(N.regroup_documents(rest, names))
        stats = stats.unionByName(V.table_stats(rest, names))
    return rows, stats


def annotation_files(spark, d) -> DataFrame:
    """File facts of the annotations: unreadable text, non-objects and stated sizes."""
    o = bridge.table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("ann/"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("json_path"),
        (F.col("o_custkey") % 101 != 7).alias("readable"), (F.col("o_custkey") % 103 != 9).alias("is_object"),
        F.lit(256).alias("width"), F.lit(256).alias("height"),
    )


def image_facts(spark, d) -> DataFrame:
    o = bridge.table(spark, d, "orders").where("o_orderkey % 11 <> 0")
    side = F.when(F.col("o_orderkey") % 97 == 5, F.lit(None)).when(F.col("o_custkey") % 17 == 0, 300).otherwise(256)
    return o.select(
        F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("img/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("image_path"),
        side.cast("int").alias("image_width"), F.when(side.isNotNull(), 256).cast("int").alias("image_height"),
    )


def annotations(spark, d) -> DataFrame:
    return sample_stats(spark, d).join(annotation_files(spark, d), "sample_id")


def inspected(spark, d) -> DataFrame:
    return V.inspect(image_facts(spark, d), annotations(spark, d))


STATS = """stats AS MATERIALIZED (
  SELECT p.sample_id, p.point_count, coalesce(e.edge_count, 0) AS edge_count, coalesce(i.issue_count, 0) AS issue_count,
         coalesce(o.overflow_count, 0) AS overflow_count, coalesce(o.shown, '') AS shown
  FROM (SELECT sample_id, count(*) AS point_count FROM pts GROUP BY 1) p
  LEFT JOIN (SELECT sample_id, count(*) AS edge_count FROM eds GROUP BY 1) e USING (sample_id)
  LEFT JOIN (SELECT sample_id, count(*) AS issue_count FROM issues GROUP BY 1) i USING (sample_id)
  LEFT JOIN (SELECT sample_id, count(*) AS overflow_count, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) FILTER (WHERE r <= 10) AS shown
             FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY id) AS r FROM (
                   SELECT sample_id, id, count(*) AS degree FROM (SELECT sample_id, u AS id FROM eds UNION ALL SELECT sample_id, v FROM eds)
                   GROUP BY 1, 2 HAVING count(*) > 2)) GROUP BY 1) o USING (sample_id))"""
INSPECTED = """imgs AS (
  SELECT o_orderkey AS sample_id, 'img/' || o_orderkey || '.png' AS image_path,
         CASE WHEN o_orderkey % 97 = 5 THEN NULL WHEN o_custkey % 17 = 0 THEN 300 ELSE 256 END AS image_width
  FROM orders WHERE o_orderkey % 11 <> 0),
anns AS (
  SELECT s.*, 'ann/' || o_orderkey || '.json' AS json_path, o_custkey % 101 <> 7 AS readable, o_custkey % 103 <> 9 AS is_object
  FROM stats s JOIN orders ON o_orderkey = s.sample_id),
stated AS (
  SELECT coalesce(i.sample_id, a.sample_id) AS sample_id, i.image_path, a.json_path, i.image_width, a.point_count, a.edge_count, a.issue_count,
         a.overflow_count, a.shown,
         CASE WHEN i.sample_id IS NULL THEN 'ORPHAN' WHEN a.sample_id IS NULL THEN 'MISSING_ANNOTATION'
              WHEN NOT a.readable THEN 'JSON_READ_FAILED' WHEN i.image_width IS NULL THEN 'IMAGE_READ_FAILED'
              WHEN NOT a.is_object THEN 'NOT_AN_OBJECT' ELSE 'INSPECTED' END AS state
  FROM imgs i FULL JOIN anns a ON i.sample_id = a.sample_id),
insp AS MATERIALIZED (
  SELECT sample_id, image_path, json_path, state, state NOT IN ('ORPHAN', 'MISSING_ANNOTATION') AS paired,
         CASE WHEN state = 'INSPECTED' THEN point_count ELSE 0 END AS point_count,
         CASE WHEN state = 'INSPECTED' THEN edge_count ELSE 0 END AS edge_count,
         CASE WHEN state = 'INSPECTED' THEN issue_count WHEN state = 'ORPHAN' THEN 0 ELSE 1 END AS error_count,
         CASE WHEN state = 'INSPECTED' THEN CAST(image_width <> 256 AS INTEGER) + CAST(overflow_count > 0 AS INTEGER) ELSE 0 END AS warning_count,
         CASE WHEN state = 'INSPECTED' THEN overflow_count ELSE 0 END AS overflow_count,
         CASE WHEN state = 'INSPECTED' THEN shown ELSE '' END AS overflow_shown, image_width
  FROM stated)"""
FULL = (*NORMALIZED, ISSUES, STATS, INSPECTED)
SUMMARY = """SELECT count_if(state <> 'ORPHAN') AS num_images, count_if(state <> 'MISSING_ANNOTATION') AS num_annotations,
  count_if(paired) AS paired_samples, count_if(state = 'MISSING_ANNOTATION') AS missing_annotations, count_if(state = 'ORPHAN') AS orphan_annotations,
  count_if(paired AND error_count > 0) AS samples_with_errors, count_if(paired AND warning_count > 0) AS samples_with_warnings,
  count_if(state = 'JSON_READ_FAILED') AS invalid_json, count_if(state = 'IMAGE_READ_FAILED') AS invalid_image,
  count_if(paired AND overflow_count > 0) AS degree_overflow_samples, count_if(paired AND point_count = 0) AS zero_point_samples,
  count_if(paired AND point_count = 1) AS one_point_samples, count_if(paired AND edge_count = 0) AS zero_edge_samples,
  count_if(paired AND edge_count > 0) AS samples_with_edges, count_if(paired AND point_count > 0) AS samples_with_points FROM insp"""
CATEGORIES = """cats AS MATERIALIZED (
  SELECT sample_id, 1 AS k, 'missing_annotation' AS category FROM insp WHERE state = 'MISSING_ANNOTATION'
  UNION ALL SELECT sample_id, 2, 'orphan_annotation' FROM insp WHERE state = 'ORPHAN'
  UNION ALL SELECT sample_id, 3, 'error' FROM insp WHERE paired AND error_count > 0
  UNION ALL SELECT sample_id, 4, 'warning' FROM insp WHERE paired AND warning_count > 0
  UNION ALL SELECT sample_id, 5, 'zero_point' FROM insp WHERE paired AND point_count = 0
  UNION ALL SELECT sample_id, 6, 'one_point' FROM insp WHERE paired AND point_count = 1
  UNION ALL SELECT sample_id, 7, 'zero_edge' FROM insp WHERE paired AND edge_count = 0)"""

TOLD = """told AS MATERIALIZED (
  SELECT sample_id, 1 AS part, pos, '  error: point id ' || raw_id || ' 重复，已重排' AS text FROM given WHERE given <> raw_id
  UNION ALL SELECT sample_id, 2, pos, '  error: edge[' || pos || '] 引用了不存在的点 ' || raw_src || '/' || raw_dst || '，已跳过' FROM marked WHERE code = 'EDGE_DANGLING'
  UNION ALL SELECT sample_id, 2, pos, '  error: edge[' || pos || '] 是自环，已跳过' FROM marked WHERE code = 'EDGE_SELF_LOOP'
  UNION ALL SELECT sample_id, 2, pos, '  error: edge[' || pos || '] 与已有边重复，已去重' FROM ranked WHERE nth > 1)"""


# ---------------------------------------------------------------- normalisation


@query("p11_normalize_points", with_ctes("SELECT sample_id, id, x, y, round(score, 6) AS score FROM pts", ELEMENTS, RAW_POINTS, FOLD, NORM_POINTS))
def normalize_points(spark, d):
    return normalized(spark, d).points.select("sample_id", "id", "x", "y", r6("score"))


@query("p12_normalize_edges", with_ctes("SELECT sample_id, edge_id, u AS src, v AS dst, 1 AS label, 'manual' AS source FROM eds", *NORMALIZED))
def normalize_edges(spark, d):
    return normalized(spark, d).edges


@query("p13_issue_list", with_ctes("""SELECT i.sample_id, i.part, i.pos, 'error' AS level, i.code,
  CASE i.code WHEN 'POINT_ID_DUP' THEN 'point id ' || g.raw_id || ' 重复，已重排'
    WHEN 'EDGE_DANGLING' THEN 'edge[' || i.pos || '] 引用了不存在的点 ' || m.raw_src || '/' || m.raw_dst || '，已跳过'
    WHEN 'EDGE_SELF_LOOP' THEN 'edge[' || i.pos || '] 是自环，已跳过' ELSE 'edge[' || i.pos || '] 与已有边重复，已去重' END AS message
  FROM issues i JOIN (SELECT sample_id * 65536 + pos AS k, raw_id FROM given) g ON g.k = i.sample_id * 65536 + i.pos
    JOIN (SELECT sample_id * 65536 + pos AS k, raw_src, raw_dst FROM marked) m ON m.k = i.sample_id * 65536 + i.pos""", *NORMALIZED, ISSUES))
def issue_list(spark, d):
    return normalized(spark, d).issues


@query("w1_dense_ids", with_ctes("SELECT sample_id, pos, given, new_id FROM given", ELEMENTS, RAW_POINTS, FOLD))
def dense_ids(spark, d):
    """Given and dense ids through running totals alone, the form that large samples take."""
    from annograph.plans.skew import running

    points, _ = tables(spark, d)
    given = N.assign_ids_by_scan(points)
    ranked = running(given, ["sample_id"], "given", [("rank", "sum", F.lit(1), True)])
    return ranked.select("sample_id", "pos", "given", (F.col("rank") - 1).cast("int").alias("new_id"))


@query("w2_first_link_wins", with_ctes("SELECT sample_id, u, v, pos FROM ranked WHERE nth = 1", *NORMALIZED))
def first_link_wins(spark, d):
    """Table form of the link rules on all samples: position of the surviving link per pair of ends."""
    points, edges = tables(spark, d)
    norm = N.normalize_large(points, edges.withColumn("edge_id", F.col("pos").cast("string")))
    return norm.edges.select("sample_id", F.col("src").alias("u"), F.col("dst").alias("v"), F.col("edge_id").cast("int").alias("pos"))


@query("w3_link_numbers", with_ctes("SELECT sample_id, edge_id, u, v FROM eds", *NORMALIZED))
def link_numbers(spark, d):
    points, edges = tables(spark, d)
    return N.normalize_large(points, edges).edges.select("sample_id", "edge_id", F.col("src").alias("u"), F.col("dst").alias("v"))


@query("p14_clean_points", with_ctes("""SELECT sample_id, pos, CASE WHEN id % 3 = 0 THEN pos ELSE id END AS id, x, y,
  CASE WHEN id % 5 = 0 THEN 1.0 ELSE round(score, 6) END AS score, CASE WHEN id % 2 = 0 THEN 'manual' ELSE 'model' END AS source FROM raw_points""", ELEMENTS, RAW_POINTS))
def clean_points(spark, d):
    points, _ = tables(spark, d)
    gaps = points.select(
        "sample_id", "pos", F.when(F.col("id") % 3 != 0, F.col("id")).alias("id"), "x", "y",
        F.when(F.col("id") % 5 != 0, F.col("score")).alias("score"), F.when(F.col("id") % 2 != 0, "model").alias("source"),
    )
    return N.clean_points(gaps).withColumn("score", r6("score"))


@query("p15_clean_edges", with_ctes("""SELECT sample_id, format('edge_{:04d}', row_number() OVER (PARTITION BY sample_id ORDER BY pos)) AS edge_id, src, dst FROM (
  SELECT sample_id, least(src - 2, dst) AS src, greatest(src - 2, dst) AS dst, min(pos) AS pos FROM raw_edges
  WHERE src - 2 >= 0 AND dst >= 0 AND src - 2 <> dst GROUP BY 1, 2, 3)""", *BASE))
def clean_edges(spark, d):
    _, edges = tables(spark, d)
    return N.clean_edges(edges.withColumn("src", F.col("src") - 2)).select("sample_id", "edge_id", "src", "dst")


@query("p16_edge_set", with_ctes("SELECT DISTINCT sample_id, least(src, dst) AS u, greatest(src, dst) AS v FROM raw_pred WHERE src <> dst", ELEMENTS, RAW_PRED))
def edge_set(spark, d):
    return N.edge_set(bridge.edges_predicted(spark, d))


@query("p17_rounded_points", with_ctes("""SELECT sample_id, id, CAST(round_even(arg_max(x, pos) / 2, 0) AS INTEGER) AS x, CAST(round_even(arg_max(y, pos) / 2, 0) AS INTEGER) AS y
  FROM raw_points GROUP BY 1, 2""", ELEMENTS, RAW_POINTS))
def rounded_points(spark, d):
    points, _ = tables(spark, d)
    return N.rounded_points(points.withColumn("x", F.col("x") / 2).withColumn("y", F.col("y") / 2))


# ---------------------------------------------------------------- validation


@query("a1_validation_summary", with_ctes(SUMMARY, *FULL))
def validation_summary(spark, d):
    return V.summarize(inspected(spark, d))


@query("a1_sample_report", with_ctes("""SELECT sample_id, image_path, json_path, state, point_count, edge_count, error_count, warning_count, overflow_count, overflow_shown FROM insp""", *FULL))
def sample_report(spark, d):
    return inspected(spark, d).select(
        "sample_id", "image_path", "json_path", "state", "point_count", "edge_count", "error_count", "warning_count", "overflow_count", "overflow_shown"
    )


@query("a2_count_histograms", with_ctes("""SELECT 'points' AS kind, least(point_count, 20) AS bucket, count(*) AS n FROM insp WHERE paired GROUP BY 1, 2
  UNION ALL SELECT 'edges', least(edge_count, 20), count(*) FROM insp WHERE paired GROUP BY 1, 2""", *FULL))
def count_histograms(spark, d):
    return V.histogram(inspected(spark, d))


@query("a3_degree_overflow", with_ctes("SELECT sample_id, overflow_count, shown AS overflow_shown FROM stats WHERE overflow_count > 0", *NORMALIZED, ISSUES, STATS))
def degree_overflow(spark, d):
    """Top-ten ids per sample through the element tables."""
    return V.overflow_points(normalized(spark, d).edges)


@query("a3_point_degrees", with_ctes("""SELECT sample_id, id, count(*) AS degree FROM (SELECT sample_id, u AS id FROM eds UNION ALL SELECT sample_id, v FROM eds) GROUP BY 1, 2""", *NORMALIZED))
def point_degrees(spark, d):
    return V.degrees(normalized(spark, d).edges)


@query("a4_findings", with_ctes("SELECT sample_id, category FROM cats", *FULL, CATEGORIES))
def findings(spark, d):
    return V.findings(inspected(spark, d))


@query("a5_findings_digest", with_ctes("SELECT sample_id, '[' || sample_id || '] ' || string_agg(category, ', ' ORDER BY k) AS line FROM cats GROUP BY 1", *FULL, CATEGORIES))
def findings_digest(spark, d):
    return V.findings_digest(inspected(spark, d))


@query("a5_digest_lines", with_ctes("""SELECT sample_id, -2 AS part, 0 AS pos, '[' || sample_id || '] ' || string_agg(category, ', ' ORDER BY k) AS line FROM cats GROUP BY 1
  UNION ALL SELECT sample_id, -1, 0, '  counts: points=' || point_count || ' edges=' || edge_count FROM insp SEMI JOIN cats USING (sample_id) WHERE paired
  UNION ALL SELECT sample_id, part, pos, text FROM told SEMI JOIN (SELECT sample_id FROM insp WHERE state = 'INSPECTED') USING (sample_id)
  UNION ALL SELECT sample_id, 0, 0, '  error: ' || CASE state WHEN 'ORPHAN' THEN '缺少对应图片文件' WHEN 'MISSING_ANNOTATION' THEN '缺少标注文件'
    WHEN 'JSON_READ_FAILED' THEN 'JSON 读取失败: invalid document' WHEN 'IMAGE_READ_FAILED' THEN '图片读取失败: unreadable image' ELSE '标注内容不是有效 JSON 对象' END
    FROM insp WHERE state <> 'INSPECTED'
  UNION ALL SELECT sample_id, 4, 0, '  warning: image_size 与实际图片不一致: 标注=(256,256) 实际=(' || image_width || ',256)' FROM insp WHERE state = 'INSPECTED' AND image_width <> 256
  UNION ALL SELECT sample_id, 4, 1, '  warning: ' || overflow_count || ' 个点的度数超过 2: [' || overflow_shown || ']' FROM insp WHERE state = 'INSPECTED' AND overflow_count > 0""",
       *FULL, CATEGORIES, TOLD))
def digest_lines(spark, d):
    """The corpus is normalised once and written; counts and messages both read that table."""
    docs, large = N.split_by_size(*tables(spark, d))
    docs = materialize(N.normalize_documents(docs).drop("raw_points", "raw_edges"), "normalized")
    stats, issues = V.document_stats(docs), docs.select("sample_id", F.inline("issues"))
    if large is not None:
        rest = N.normalize_large(*large)
        stats, issues = stats.unionByName(V.table_stats(rest, large_names(large))), issues.unionByName(rest.issues)
    seen = V.inspect(image_facts(spark, d), stats.join(annotation_files(spark, d), "sample_id"))
    return V.digest_lines(materialize(seen, "inspected"), issues)


@query("a6_summary_lines", with_ctes("""SELECT 0 AS line_no, 'images=' || num_images || ' annotations=' || num_annotations || ' paired=' || paired_samples AS line FROM s
  UNION ALL SELECT 1, 'missing_annotations=' || missing_annotations || ' orphan_annotations=' || orphan_annotations FROM s
  UNION ALL SELECT 2, 'zero_point=' || zero_point_samples || ' one_point=' || one_point_samples || ' zero_edge=' || zero_edge_samples FROM s
  UNION ALL SELECT 3, 'samples_with_errors=' || samples_with_errors || ' samples_with_warnings=' || samples_with_warnings FROM s""", *FULL, f"s AS ({SUMMARY})"))
def summary_lines(spark, d):
    return V.summary_lines(V.summarize(inspected(spark, d)))


@query("k6_validation_report", with_ctes(SUMMARY, *FULL))
def validation_report(spark, d):
    """Report written to the shared folder and the summary read back."""
    from annograph.plans.session import shared_dir

    facts, stats = image_facts(spark, d), materialize(annotations(spark, d), "stats")
    out = writers.versioned_path(f"{shared_dir(spark)}/annograph/report")
    result = V.validate(facts, stats)
    writers.write_report(result, out)
    return spark.read.schema(result.summary.schema).json(f"{out}/summary")


@query("t1_sorted_samples", with_ctes("SELECT sample_id, point_count FROM insp WHERE paired ORDER BY sample_id", *FULL))
def sorted_samples(spark, d):
    return inspected(spark, d).where("paired").select("sample_id", "point_count").orderBy("sample_id")


# ---------------------------------------------------------------- pairing


DOC_FILES = """imgf AS (SELECT doc_id, 'doc_' || lang || '_' || doc_id AS stem, source || '/doc_' || lang || '_' || doc_id || '.png' AS path FROM documents WHERE doc_id % 7 <> 0),
annf AS (SELECT l.doc_id, 'doc_' || d.lang || '_' || l.doc_id AS stem, 'ann/doc_' || d.lang || '_' || l.doc_id || '.json' AS path FROM labels l JOIN documents d USING (doc_id))"""


def doc_images(spark, d, every: bool = False):
    docs = bridge.table(spark, d, "documents").select("doc_id", "lang", "source")
    docs = docs if every else docs.where("doc_id % 7 <> 0")
    stem = F.concat(F.lit("doc_"), "lang", F.lit("_"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", stem.alias("stem"), F.concat("source", F.lit("/"), stem, F.lit(".png")).alias("path"))


def doc_annotations(spark, d):
    docs = bridge.table(spark, d, "documents").select("doc_id", "lang")
    labels = bridge.table(spark, d, "labels").select("doc_id").join(docs, "doc_id")
    stem = F.concat(F.lit("doc_"), "lang", F.lit("_"), F.col("doc_id").cast("string"))
    return labels.select("doc_id", stem.alias("stem"), F.concat(F.lit("ann/"), stem, F.lit(".json")).alias("path"))


@query("j1_paired", with_ctes("SELECT i.stem, i.path AS image_path, a.path AS json_path FROM imgf i JOIN annf a USING (stem)", DOC_FILES))
def paired(spark, d):
    return pairing.paired(doc_images(spark, d).select("stem", F.col("path").alias("image_path")), doc_annotations(spark, d).select("stem", F.col("path").alias("json_path")))


@query("j2_missing_annotations", with_ctes("SELECT stem AS sample_id, path FROM imgf WHERE stem NOT IN (SELECT stem FROM annf)", DOC_FILES))
def missing(spark, d):
    name = lambda t: t.select(F.col("stem").alias("sample_id"), "path")
    return V.missing_annotations(name(doc_images(spark, d)), name(doc_annotations(spark, d)))


@query("j3_orphan_annotations", with_ctes("SELECT stem AS sample_id, path FROM annf WHERE stem NOT IN (SELECT stem FROM imgf)", DOC_FILES))
def orphans(spark, d):
    name = lambda t: t.select(F.col("stem").alias("sample_id"), "path")
    return V.orphan_annotations(name(doc_images(spark, d)), name(doc_annotations(spark, d)))


@query("u2_stem_difference", with_ctes("SELECT stem, 'image' AS only_in FROM (SELECT stem FROM imgf EXCEPT SELECT stem FROM annf) UNION ALL SELECT stem, 'annotation' FROM (SELECT stem FROM annf EXCEPT SELECT stem FROM imgf)", DOC_FILES))
def stem_difference(spark, d):
    i, a = doc_images(spark, d).select("stem"), doc_annotations(spark, d).select("stem")
    return i.subtract(a).withColumn("only_in", F.lit("image")).unionByName(a.subtract(i).withColumn("only_in", F.lit("annotation")))


@query("j5_review_items", with_ctes("SELECT i.stem, i.path AS image_path, a.path AS label_path, true AS required FROM imgf i JOIN annf a USING (stem) UNION ALL SELECT i.stem, i.path, a.path, false FROM imgf i LEFT JOIN annf a USING (stem)", DOC_FILES))
def review_items(spark, d):
    i, a = doc_images(spark, d), doc_annotations(spark, d)
    return pairing.filter_items(i, a, True).withColumn("required", F.lit(True)).unionByName(pairing.filter_items(i, a, False).withColumn("required", F.lit(False)))


@query("a16_label_counts", with_ctes("SELECT count(a.path) AS labelled, count(*) - count(a.path) AS unlabelled FROM imgf i LEFT JOIN annf a USING (stem)", DOC_FILES))
def label_counts(spark, d):
    return pairing.label_counts(pairing.filter_items(doc_images(spark, d), doc_annotations(spark, d), False))


@query("j6_folder_items", with_ctes("SELECT i.stem, i.path AS image_path, a.path AS source_path FROM imgf i LEFT JOIN (SELECT stem, max(path) AS path FROM annf GROUP BY 1) a USING (stem)", DOC_FILES))
def folder_items(spark, d):
    return pairing.folder_items(doc_images(spark, d), doc_annotations(spark, d))


SUFFIXED = """sfx AS (
  SELECT doc_id, 'doc_' || lang || '_' || doc_id AS stem,
    list_distinct([CASE doc_id % 4 WHEN 0 THEN '.webp' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' ELSE '.tif' END,
                   CASE doc_id % 3 WHEN 0 THEN '.jpeg' WHEN 1 THEN '.bmp' ELSE '.webp' END]) AS suffixes FROM documents),
imgs2 AS (SELECT doc_id, stem, unnest(suffixes) AS suffix FROM sfx),
ann2 AS (SELECT l.doc_id, 'ann/doc_' || d.lang || '_' || l.doc_id || '.json' AS path, 'doc_' || d.lang || '_' || l.doc_id AS stem,
   CASE l.doc_id % 5 WHEN 0 THEN 'raw/doc_' || d.lang || '_' || l.doc_id || '.bmp' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'gone/nothing.png' END AS image_path FROM labels l JOIN documents d USING (doc_id))"""


def suffixed_images(spark, d):
    docs = bridge.table(spark, d, "documents").select("doc_id", "lang")
    k = F.col("doc_id")
    pick = lambda m, *s: F.element_at(F.array(*[F.lit(x) for x in s]), (k % m + 1).cast("int"))
    suffixes = F.array_distinct(F.array(pick(4, ".webp", ".jpg", ".png", ".tif"), pick(3, ".jpeg", ".bmp", ".webp")))
    stem = F.concat(F.lit("doc_"), "lang", F.lit("_"), k.cast("string"))
    each = docs.select("doc_id", stem.alias("stem"), F.explode(suffixes).alias("suffix"))
    return each.withColumn("path", F.concat(F.lit("img/"), "stem", "suffix"))


def stated_annotations(spark, d):
    a = doc_annotations(spark, d)
    k = F.col("doc_id") % 5
    stated = F.when(k == 0, F.concat(F.lit("raw/"), "stem", F.lit(".bmp"))).when(k == 1, "").when(k == 2, F.lit(None)).otherwise("gone/nothing.png")
    return a.withColumn("image_path", stated)


@query("w9_last_file_per_stem", with_ctes("SELECT stem, max('img/' || stem || suffix) AS path FROM imgs2 GROUP BY 1", SUFFIXED))
def last_file(spark, d):
    return V.last_per_stem(suffixed_images(spark, d).select("stem", "path"))


@query("j7_training_pairs", with_ctes("""SELECT stem, json_path, image_path FROM (SELECT a.stem, a.path AS json_path, 'img/' || i.stem || i.suffix AS image_path,
  row_number() OVER (PARTITION BY a.path ORDER BY list_position(['.bmp', '.png', '.jpg', '.jpeg', '.tif', '.tiff'], i.suffix)) AS r
  FROM ann2 a JOIN imgs2 i ON i.stem = a.stem AND i.suffix <> '.webp') WHERE r = 1""", SUFFIXED))
def training_pairs(spark, d):
    return pairing.training_pairs(suffixed_images(spark, d), doc_annotations(spark, d))


@query("j8_resolve_images", with_ctes("""SELECT a.path AS json_path, coalesce(n.file, s.file) AS image_path,
  CASE WHEN n.file IS NULL AND s.file IS NULL THEN 'IMAGE_NOT_FOUND' END AS error FROM ann2 a
  LEFT JOIN (SELECT stem || suffix AS name, 'img/' || stem || suffix AS file FROM imgs2) n ON n.name = regexp_extract(coalesce(a.image_path, ''), '[^/]*$')
  LEFT JOIN (SELECT stem, arg_min('img/' || stem || suffix, list_position(['.png', '.jpg', '.jpeg', '.bmp', '.tif', '.tiff', '.webp'], suffix)) AS file
             FROM imgs2 WHERE doc_id % 9 <> 0 GROUP BY 1) s ON s.stem = a.stem WHERE true""".replace("WHERE doc_id % 9 <> 0 ", ""), SUFFIXED))
def resolve_images(spark, d):
    return pairing.resolve_images(stated_annotations(spark, d), suffixed_images(spark, d))


@query("j9_resolve_images_prediction", with_ctes("""SELECT a.path AS json_path, coalesce(s.file, coalesce(a.image_path, '')) AS image_path FROM ann2 a
  LEFT JOIN (SELECT stem, arg_min('img/' || stem || suffix, list_position(['.bmp', '.jpg', '.jpeg', '.png', '.tif', '.tiff', '.webp'], suffix)) AS file
             FROM imgs2 WHERE suffix <> '.webp' GROUP BY 1) s ON s.stem = a.stem""", SUFFIXED))
def resolve_images_prediction(spark, d):
    return pairing.resolve_images_for_prediction(stated_annotations(spark, d), suffixed_images(spark, d).where("suffix <> '.webp'"), "img")


# ---------------------------------------------------------------- export


def _manifest_sql(bad: str) -> str:
    return f"""SELECT sample_id, CASE WHEN {bad} THEN 'error' ELSE 'ok' END AS route, image_path AS image_src,
  CASE WHEN {bad} THEN 'out/error/' ELSE 'out/images/' END || sample_id || '.png' AS image_dst, json_path AS json_src,
  CASE WHEN NOT ({bad}) THEN 'out/annotations/' || sample_id || '.json' WHEN json_path IS NOT NULL THEN 'out/error/' || sample_id || '.json' END AS json_dst
  FROM insp WHERE state <> 'ORPHAN'"""


BAD_A = "error_count > 0 OR point_count = 0"
BAD_B = "error_count > 0 OR point_count <= 1 OR edge_count = 0"


@query("k2_point_export_manifest", with_ctes(_manifest_sql(BAD_A), *FULL))
def point_export(spark, d):
    return X.export_manifest(inspected(spark, d), "points", "out")


@query("k3_edge_export_manifest", with_ctes(_manifest_sql(BAD_B), *FULL))
def edge_export(spark, d):
    return X.export_manifest(inspected(spark, d), "edges", "out")


@query("x1_error_routes", with_ctes(f"""SELECT 'points' AS kind, CASE WHEN {BAD_A} THEN 'error' ELSE 'ok' END AS route, count(*) AS n FROM insp WHERE state <> 'ORPHAN' GROUP BY 1, 2
  UNION ALL SELECT 'edges', CASE WHEN {BAD_B} THEN 'error' ELSE 'ok' END, count(*) FROM insp WHERE state <> 'ORPHAN' GROUP BY 1, 2""", *FULL))
def error_routes(spark, d):
    """Both exports from one inspection."""
    rows = inspected(spark, d).where("state <> 'ORPHAN'")
    both = rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), X.route(k).alias("route")) for k in X.KINDS])))
    return both.groupBy("kind", "route").agg(F.count(F.lit(1)).alias("n"))


@query("a7_export_counters", with_ctes(f"SELECT count_if(NOT ({BAD_B})) AS images_exported, count_if(NOT ({BAD_B})) AS annotations_exported, count_if({BAD_B}) AS samples_routed_to_error, 0 AS skipped_empty_annotations FROM insp WHERE state <> 'ORPHAN'", *FULL))
def export_counters(spark, d):
    return X.export_counters(X.export_manifest(inspected(spark, d), "edges", "out"))


@query("j4_export_drive", with_ctes("SELECT i.sample_id, i.image_path, a.json_path FROM imgs i LEFT JOIN anns a ON a.sample_id = i.sample_id", *FULL))
def export_drive(spark, d):
    files = annotation_files(spark, d).join(bridge.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id")), "sample_id", "left_semi")
    return image_facts(spark, d).join(files, "sample_id", "left").select("sample_id", "image_path", "json_path")


DECIDED = "i.stem, CASE WHEN i.doc_id % 4 = 1 THEN 'trash' ELSE 'keep' END AS route"


@query("x2_keep_or_trash", with_ctes(f"""SELECT stem AS sample_id, route, src, CASE WHEN route = 'trash' THEN 'trash/' ELSE 'keep/' END || regexp_extract(src, '[^/]*$') AS dst, regexp_extract(src, '\\.[^.]*$') AS suffix FROM (
  SELECT {DECIDED}, i.path AS src FROM imgf i UNION ALL SELECT {DECIDED}, a.path FROM imgf i JOIN annf a USING (stem))""", DOC_FILES))
def keep_or_trash(spark, d):
    images = doc_images(spark, d)
    items = pairing.filter_items(images, doc_annotations(spark, d), False).withColumnRenamed("stem", "sample_id")
    told = images.where("doc_id % 4 < 2").select(F.col("stem").alias("sample_id"), F.when(F.col("doc_id") % 4 == 1, "trash").otherwise("keep").alias("decision"))
    return X.decisions_manifest(items, told, "keep", "trash")


