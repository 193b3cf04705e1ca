"""Graph features, targets and splits on the normalised annotation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from annograph import bridge
from annograph.catalog.registry import BASE, NORMALIZED, query, r6, with_ctes
from annograph.catalog.validation import tables
from annograph.operators import augment as A, graph as G, normalize as N
from annograph.operators.space import nearest_tiled, pairs_within
from annograph.plans.session import materialize


def normal_form(spark, d) -> N.Normalized:
    """Normalised tables from one written pass over the corpus."""
    docs, large = N.split_by_size(*tables(spark, d))
    docs = materialize(N.normalize_documents(docs, "none").select("sample_id", "points", "edges"), "normalized")
    points, edges = docs.select("sample_id", F.inline("points")), docs.select("sample_id", F.inline("edges"))
    if large is not None:
        rest = N.normalize_large(*large)
        points, edges = points.unionByName(rest.points), edges.unionByName(rest.edges)
    return N.Normalized(points, edges, docs.limit(0))


PAIRS = """pairs AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY sample_id, i ORDER BY d, j) AS rank FROM (
    SELECT a.sample_id, a.id AS i, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
    FROM pts a JOIN pts b USING (sample_id) WHERE a.id <> b.id)),
near AS MATERIALIZED (SELECT sample_id, i, min(d) AS nearest, avg(d) FILTER (WHERE rank <= 3) AS mean3, count(*) AS others FROM pairs GROUP BY 1, 2),
fence AS (SELECT sample_id, quantile_cont(nearest, 0.25) AS q1, quantile_cont(nearest, 0.75) AS q3 FROM near GROUP BY 1),
gaps AS MATERIALIZED (SELECT n.sample_id, quantile_cont(nearest, 0.5) AS spacing FROM near n JOIN fence f USING (sample_id)
  WHERE nearest >= q1 - 1.5 * greatest(q3 - q1, 1e-6) AND nearest <= q3 + 1.5 * greatest(q3 - q1, 1e-6) GROUP BY 1),
rings AS MATERIALIZED (SELECT p.sample_id, i, count_if(d <= spacing * 1.2) AS ring1, count_if(d <= spacing * 2.2) AS ring2 FROM pairs p JOIN gaps USING (sample_id) GROUP BY 1, 2)"""
CANDIDATES = """truth AS (SELECT DISTINCT sample_id, u, v FROM eds),
cand AS MATERIALIZED (SELECT sample_id, u, v, max(label) AS label FROM (
  SELECT p.sample_id, least(i, j) AS u, greatest(i, j) AS v, 0 AS label FROM pairs p JOIN gaps USING (sample_id) WHERE d <= spacing * 2.5 OR rank <= 8
  UNION ALL SELECT sample_id, u, v, 1 FROM truth) GROUP BY 1, 2, 3)"""
NODES = """nodes AS MATERIALIZED (
  SELECT p.sample_id, p.id, p.x, p.y, p.score, spacing, p.x / 256 AS f_x, p.y / 256 AS f_y, nearest / greatest(spacing, 1e-6) AS f_nearest, mean3 / greatest(spacing, 1e-6) AS f_mean3,
    ring1 / others AS f_ring1, ring2 / others AS f_ring2, 1.0 AS f_valid
  FROM pts p JOIN near n ON n.sample_id = p.sample_id AND n.i = p.id JOIN rings r ON r.sample_id = p.sample_id AND r.i = p.id JOIN gaps g ON g.sample_id = p.sample_id)"""
GRAPH = (*NORMALIZED, PAIRS)


@query("j11_pair_distances", with_ctes("SELECT sample_id, i, count(*) AS n, round(sum(d), 6) AS total FROM pairs GROUP BY 1, 2", *GRAPH))
def pair_distances(spark, d):
    """All ordered pairs of every sample."""
    points = normal_form(spark, d).points
    reach = points.select("sample_id").distinct().withColumn("radius", F.lit(float("inf")))
    return pairs_within(points, reach).groupBy("sample_id", "i").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("d"), "total"))


@query("w4_nearest_ranks", with_ctes("SELECT sample_id, i, j, round(d, 6) AS d, rank FROM pairs WHERE rank <= 8", *GRAPH))
def nearest_ranks(spark, d):
    return G.nearest_points(normal_form(spark, d).points).withColumn("d", r6("d"))


@query("w4_nearest_ranks_grid", with_ctes("SELECT sample_id, i, j, round(d, 6) AS d, rank FROM pairs WHERE rank <= 8", *GRAPH))
def nearest_ranks_grid(spark, d):
    """The search that large samples take, on all samples."""
    return nearest_tiled(materialize(normal_form(spark, d).points, "points"), 8).withColumn("d", r6("d"))


@query("w5_nearest_and_mean3", with_ctes("SELECT sample_id, i, round(nearest, 6) AS nearest, round(mean3, 6) AS mean3 FROM near", *GRAPH))
def nearest_and_mean3(spark, d):
    stats = G.nearest_stats(G.nearest_points(normal_form(spark, d).points, G.NEAR))
    return stats.select("sample_id", "i", r6("nearest"), r6("mean3"))


@query("w6_ring_counts", with_ctes("SELECT sample_id, i AS id, ring1, ring2 FROM rings", *GRAPH))
def ring_counts(spark, d):
    nodes, _ = G.neighbour_graph(normal_form(spark, d).points)
    return nodes.select("sample_id", "id", "ring1", "ring2")


@query("a15_spacing", with_ctes("SELECT DISTINCT p.sample_id, round(coalesce(spacing, 28.0), 6) AS spacing FROM pts p LEFT JOIN gaps USING (sample_id)", *GRAPH))
def spacing(spark, d):
    return G.spacing(normal_form(spark, d).points).select("sample_id", r6("spacing"))


@query("a15_spacing_by_scan", with_ctes("SELECT sample_id, round(spacing, 6) AS spacing FROM gaps", *GRAPH))
def spacing_by_scan(spark, d):
    """Spacing through weighted running counts, the form that large samples take."""
    stats = materialize(G.nearest_stats(G.nearest_points(normal_form(spark, d).points, G.NEAR)), "nearest")
    return G.spacing_large(stats).select("sample_id", r6("spacing"))


@query("j12_neighbour_candidates", with_ctes("SELECT DISTINCT p.sample_id, least(i, j) AS u, greatest(i, j) AS v FROM pairs p JOIN gaps USING (sample_id) WHERE d <= spacing * 2.5 OR rank <= 8", *GRAPH))
def neighbour_candidates(spark, d):
    _, pairs = G.neighbour_graph(normal_form(spark, d).points)
    return G.candidate_edges(pairs).drop("label")


@query("j12_neighbour_candidates_grid", with_ctes("SELECT DISTINCT p.sample_id, least(i, j) AS u, greatest(i, j) AS v FROM pairs p JOIN gaps USING (sample_id) WHERE d <= spacing * 2.5 OR rank <= 8", *GRAPH))
def neighbour_candidates_grid(spark, d):
    """The form that large samples take, on all samples."""
    points = normal_form(spark, d).points
    more = points.join(points.where("id = 1").select("sample_id"), "sample_id", "left_semi")
    _, pairs = G.neighbour_graph(more, limit=0)
    return G.candidate_edges(pairs).drop("label")


@query("u3_candidates_with_truth", with_ctes("SELECT sample_id, u, v, label FROM cand", *GRAPH, CANDIDATES))
def candidates_with_truth(spark, d):
    n = normal_form(spark, d)
    _, pairs = G.neighbour_graph(n.points)
    return G.candidate_edges(pairs, G.known_edges(n.points, n.edges))


@query("f3_edge_labels", with_ctes("SELECT sample_id, count(*) AS n, sum(label) AS positives FROM cand GROUP BY 1", *GRAPH, CANDIDATES))
def edge_labels(spark, d):
    n = normal_form(spark, d)
    _, edges = G.graph_features(n.points, n.edges)
    return edges.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


@query("j10_known_edges", with_ctes("SELECT DISTINCT e.sample_id, least(src, dst) AS u, greatest(src, dst) AS v FROM raw_edges e JOIN (SELECT DISTINCT sample_id, id FROM raw_points) a ON a.sample_id = e.sample_id AND a.id = src JOIN (SELECT DISTINCT sample_id, id FROM raw_points) b ON b.sample_id = e.sample_id AND b.id = dst WHERE src <> dst", *BASE))
def known_edges(spark, d):
    points, edges = tables(spark, d)
    return G.known_edges(points, edges)


NODE_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" for c in ("f_x", "f_y", "f_nearest", "f_mean3", "f_ring1", "f_ring2", "f_valid"))


@query("f1_node_features", with_ctes(f"SELECT sample_id, id, {NODE_COLUMNS}, round(score, 6) AS f_score FROM nodes", *GRAPH, NODES))
def node_features(spark, d):
    n = normal_form(spark, d)
    nodes, _ = G.graph_features(n.points)
    return nodes.select("sample_id", "id", *[r6(c) for c in G.NODE_FEATURES])


EDGE_SQL = """SELECT c.sample_id, c.u, c.v, c.label, round((b.x - a.x) / a.spacing, 6) + 0.0 AS e_dx, round((b.y - a.y) / a.spacing, 6) + 0.0 AS e_dy,
  round(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) / a.spacing, 6) AS e_d, round(abs(b.x - a.x) / 256, 6) AS e_abs_dx, round(abs(b.y - a.y) / 256, 6) AS e_abs_dy,
  round(a.score, 6) AS e_score_u, round(b.score, 6) AS e_score_v, round(abs(a.score - b.score), 6) AS e_score_gap, round(a.f_ring1, 6) AS e_ring1_u, round(b.f_ring1, 6) AS e_ring1_v
  FROM cand c JOIN (SELECT * REPLACE (greatest(spacing, 1e-6) AS spacing) FROM nodes) a ON a.sample_id = c.sample_id AND a.id = c.u JOIN nodes b ON b.sample_id = c.sample_id AND b.id = c.v"""


@query("f2_edge_features", with_ctes(EDGE_SQL, *GRAPH, CANDIDATES, NODES))
def edge_features(spark, d):
    n = normal_form(spark, d)
    _, edges = G.graph_features(n.points, n.edges)
    return edges.select("sample_id", "u", "v", "label", *[r6(c) for c in G.EDGE_FEATURES])


@query("f4_feature_counts", with_ctes("SELECT n.sample_id, nodes, edges FROM (SELECT sample_id, count(*) AS nodes FROM nodes GROUP BY 1) n JOIN (SELECT sample_id, count(*) AS edges FROM cand GROUP BY 1) e USING (sample_id)", *GRAPH, CANDIDATES, NODES))
def feature_counts(spark, d):
    """Whole feature build, counted per sample; samples with fewer than two points are absent."""
    n = normal_form(spark, d)
    nodes, edges = G.graph_features(n.points, n.edges)
    count = lambda t, name: t.groupBy("sample_id").agg(F.count(F.lit(1)).alias(name))
    return count(nodes, "nodes").join(count(edges, "edges"), "sample_id")


@query("a12_graph_summary", with_ctes("""SELECT count(*) AS num_samples, round(sum(nodes) / count(*), 6) AS avg_nodes, round(sum(edges) / count(*), 6) AS avg_edges, sum(pos) AS pos_edges, sum(edges) - sum(pos) AS neg_edges, round(sum(pos) / greatest(sum(edges), 1), 6) AS pos_ratio
  FROM (SELECT sample_id, count(*) AS nodes FROM nodes GROUP BY 1) n JOIN (SELECT sample_id, count(*) AS edges, sum(label) AS pos FROM cand GROUP BY 1) e USING (sample_id)""", *GRAPH, CANDIDATES, NODES))
def graph_summary(spark, d):
    n = normal_form(spark, d)
    s = G.graph_summary(*G.graph_features(n.points, n.edges))
    return s.select("num_samples", r6("avg_nodes"), r6("avg_edges"), "pos_edges", "neg_edges", r6("pos_ratio"))


@query("a13_class_weight", with_ctes("SELECT round(greatest(count_if(label = 0), 1) / greatest(count_if(label = 1), 1), 6) AS pos_weight FROM cand", *GRAPH, CANDIDATES))
def class_weight(spark, d):
    n = normal_form(spark, d)
    _, edges = G.graph_features(n.points, n.edges)
    return G.class_weight(edges).select(r6("pos_weight"))


def _split_sql(count: str) -> str:
    return f"""SELECT sample_id, CASE WHEN r <= {count} THEN 'val' ELSE 'train' END AS part FROM (
  SELECT sample_id, count(*) OVER () AS n, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || sample_id), 1, 8) AS BIGINT), sample_id) AS r FROM (SELECT o_orderkey AS sample_id FROM orders))"""


@query("f5_split_samples", _split_sql("least(greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)), n - 1)"))
def split_samples(spark, d):
    return G.split_samples(bridge.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id")))


@query("f5_split_point_samples", _split_sql("greatest(1, CAST(trunc(n * 0.15) AS BIGINT))"))
def split_point_samples(spark, d):
    return G.split_samples(bridge.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id")), 0.15, 42, "points")


@query("g8_link_strips", with_ctes("""SELECT sample_id, u, v, round(cx, 6) AS cx, round(cy, 6) AS cy, round(half_len, 6) AS half_len, round(half_w, 6) AS half_w,
  round(cx - half_len * ux + half_w * uy, 6) + 0.0 AS x0, round(cy - half_len * uy - half_w * ux, 6) + 0.0 AS y0, round(cx + half_len * ux + half_w * uy, 6) + 0.0 AS x1, round(cy + half_len * uy - half_w * ux, 6) + 0.0 AS y1,
  round(cx - half_len * ux - half_w * uy, 6) + 0.0 AS x2, round(cy - half_len * uy + half_w * ux, 6) + 0.0 AS y2 FROM (
  SELECT e.sample_id, u, v, (a.x + b.x) * 0.5 AS cx, (a.y + b.y) * 0.5 AS cy, (b.x - a.x) / len AS ux, (b.y - a.y) / len AS uy, 0.5 * (len + greatest(spacing, 1.0)) AS half_len, 0.75 * greatest(spacing, 1.0) AS half_w
  FROM eds e JOIN pts a ON a.sample_id = e.sample_id AND a.id = u JOIN pts b ON b.sample_id = e.sample_id AND b.id = v JOIN gaps g ON g.sample_id = e.sample_id,
  LATERAL (SELECT CASE WHEN sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) < 1e-6 THEN 1.0 ELSE sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) END AS len))""", *GRAPH))
def link_strips(spark, d):
    n = normal_form(spark, d)
    space = G.neighbour_graph(n.points)[0].select("sample_id", "spacing").distinct()
    strips = G.link_strips(n.points, n.edges.select("sample_id", F.col("src").alias("u"), F.col("dst").alias("v")), space)
    return strips.select("sample_id", "u", "v", *[r6(c) for c in ("cx", "cy", "half_len", "half_w", "x0", "y0", "x1", "y1", "x2", "y2")])


def placed_points(spark, d):
    points, _ = tables(spark, d)
    return points.select("sample_id", F.col("pos").alias("id"), "x", "y", "score")


def sample_sizes(spark, d):
    o = bridge.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("sample_id"), (200 + F.col("o_custkey") % 60).cast("int").alias("width"), F.lit(240).alias("height"))


@query("p20_points_inside", with_ctes("SELECT sample_id, pos AS id FROM raw_points JOIN orders ON o_orderkey = sample_id WHERE x - 20 >= 0 AND x - 20 < 200 + o_custkey % 60 AND y < 240", *BASE))
def points_inside(spark, d):
    from annograph.operators.predict import inside_image

    shifted = placed_points(spark, d).withColumn("x", F.col("x") - 20).join(sample_sizes(spark, d), "sample_id")
    return inside_image(shifted).select("sample_id", "id")


def _u(name: str) -> str:
    return f"(CAST('0x' || substr(md5(sample_id || ':' || copy || ':42:{name}'), 1, 8) AS BIGINT) / 4294967296.0)"


AUGMENT = f"""par AS MATERIALIZED (
  SELECT *, CAST(floor({_u('padx')} * (pad * 2 + 1)) AS INTEGER) AS px, CAST(floor({_u('pady')} * (pad * 2 + 1)) AS INTEGER) AS py,
    CAST(floor({_u('cropx')} * (width - cw + 1)) AS INTEGER) AS cx0, CAST(floor({_u('cropy')} * (height - ch + 1)) AS INTEGER) AS cy0 FROM (
  SELECT *, CAST(floor(width * crop) AS INTEGER) AS cw, CAST(floor(height * crop) AS INTEGER) AS ch FROM (
  SELECT *, CASE WHEN {_u('pad?')} > 0.5 THEN 10 + CAST(floor({_u('pad')} * 41) AS INTEGER) ELSE 0 END AS pad, radians({_u('angle')} * 360.0) AS angle,
    {_u('hflip?')} > 0.5 AS hflip, {_u('vflip?')} > 0.5 AS vflip, CASE WHEN {_u('shift?')} > 0.3 THEN ({_u('tx')} * 0.4 - 0.2) * width ELSE 0.0 END AS tx,
    CASE WHEN {_u('shift?')} > 0.3 THEN ({_u('ty')} * 0.4 - 0.2) * height ELSE 0.0 END AS ty, CASE WHEN {_u('scale?')} > 0.3 THEN 0.8 + {_u('scale')} * 0.4 ELSE 1.0 END AS scale,
    CASE WHEN {_u('crop?')} > 0.3 THEN 0.7 + {_u('crop')} * 0.3 ELSE 1.0 END AS crop
  FROM (SELECT o_orderkey AS sample_id, CAST(200 + o_custkey % 60 AS INTEGER) AS width, 240 AS height, unnest(range(1, 7)) AS copy FROM orders)))),
a1 AS (SELECT p.* EXCLUDE (x, y), q.*, p.x + pad - px AS x, p.y + pad - py AS y FROM raw_points p JOIN par q USING (sample_id)),
a2 AS (SELECT * EXCLUDE (x, y), cos(angle) * (x - width / 2) + sin(angle) * (y - height / 2) + width / 2 AS x, -sin(angle) * (x - width / 2) + cos(angle) * (y - height / 2) + height / 2 AS y FROM a1),
a3 AS (SELECT * EXCLUDE (x, y), CASE WHEN hflip THEN width - 1 - x ELSE x END + tx AS x, CASE WHEN vflip THEN height - 1 - y ELSE y END + ty AS y FROM a2),
a4 AS (SELECT * EXCLUDE (x, y), (x - width / 2) * scale + width / 2 AS x, (y - height / 2) * scale + height / 2 AS y FROM a3),
a5 AS (SELECT * EXCLUDE (x, y), (x - cx0) * (width / cw) AS x, (y - cy0) * (height / ch) AS y FROM a4)"""


@query("g10_augmented_points", with_ctes("SELECT sample_id, copy, pos AS id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM a5 WHERE x >= 0 AND x < width AND y >= 0 AND y < height", *BASE, AUGMENT))
def augmented_points(spark, d):
    out = A.augment_points(placed_points(spark, d), sample_sizes(spark, d))
    return out.select("sample_id", "copy", "id", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


@query("a19_heatmap_targets", with_ctes("""SELECT sample_id, count(*) AS pixels, round(sum(v), 4) AS mass, max(x) AS right_edge, max(y) AS low_edge FROM (
  SELECT sample_id, px + dx AS x, py + dy AS y, max(exp(-(dx * dx + dy * dy) / 8.0)) AS v FROM (
  SELECT DISTINCT sample_id, CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py, CAST(200 + o_custkey % 60 AS INTEGER) AS width FROM raw_points JOIN orders ON o_orderkey = sample_id),
  (SELECT CAST(unnest(range(-6, 7)) AS INTEGER) AS dx) a, (SELECT CAST(unnest(range(-6, 7)) AS INTEGER) AS dy) b
  WHERE px + dx >= 0 AND px + dx < width AND py + dy >= 0 AND py + dy < 240 GROUP BY 1, 2, 3) GROUP BY 1""", *BASE))
def heatmap_targets(spark, d):
    points = placed_points(spark, d).join(sample_sizes(spark, d), "sample_id")
    return A.heatmap_targets(points).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.sum("v"), 4).alias("mass"), F.max("x").alias("right_edge"), F.max("y").alias("low_edge")
    )
