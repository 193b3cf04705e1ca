"""Normalisation rules: literal cases, and both forms against a plain fold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from annograph.operators import normalize as N
from annograph.operators.validate import document_stats, table_stats
from annograph.sources.annotations import parse_annotations

POINTS = "sample_id long, pos int, is_object boolean, id int, x double, y double, score double, source string"
EDGES = "sample_id long, pos int, is_object boolean, edge_id string, src int, dst int, label int, source string"


def fold(ids):
    used, top, out = set(), 0, []
    for i in ids:
        if i in used:
            i = top
            while i in used:
                i += 1
        used.add(i)
        top = max(top, i + 1)
        out.append(i)
    return out


def link_fold(given, raw):
    """(kept [(u, v)], codes by position)."""
    dense = {g: n for n, g in enumerate(sorted(given))}
    kept, codes = [], {}
    for pos, (a, b) in enumerate(raw):
        if a is None or b is None:
            codes[pos] = "EDGE_INVALID"
        elif a not in dense or b not in dense:
            codes[pos] = "EDGE_DANGLING"
        elif dense[a] == dense[b]:
            codes[pos] = "EDGE_SELF_LOOP"
        else:
            key = tuple(sorted((dense[a], dense[b])))
            if key in kept:
                codes[pos] = "EDGE_DUP"
            else:
                kept.append(key)
    return kept, codes


def random_tables(spark, seed=7, samples=120):
    rng = random.Random(seed)
    points, edges, raw = [], [], {}
    for s in range(samples):
        top = rng.choice([2, 6, 15, 40])
        ids = [rng.randint(-1, top) for _ in range(rng.randint(1, 30))]
        links = [(rng.choice([None, *range(-1, top)]), rng.randint(-1, top)) for _ in range(rng.randint(0, 25))]
        raw[s] = (ids, links)
        points += [(s, p, True, i, float(p), float(i), 1.0, "m") for p, i in enumerate(ids)]
        edges += [(s, p, True, None, a, b, 1, "m") for p, (a, b) in enumerate(links)]
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(edges, EDGES), raw


def check(norm, raw):
    points, edges, issues = norm.points.collect(), norm.edges.collect(), norm.issues.collect()
    for s, (ids, links) in raw.items():
        given = fold(ids)
        kept, codes = link_fold(given, links)
        order = sorted(range(len(ids)), key=lambda p: given[p])
        assert sorted((r.id, r.x) for r in points if r.sample_id == s) == [(n, float(p)) for n, p in enumerate(order)]
        mine = sorted((r.edge_id, r.src, r.dst) for r in edges if r.sample_id == s)
        assert mine == sorted((f"edge_{n + 1:04d}", *k) for n, k in enumerate(kept))
        expected = {(1, p, "POINT_ID_DUP") for p in range(len(ids)) if given[p] != ids[p]} | {(2, p, c) for p, c in codes.items()}
        assert {(r.part, r.pos, r.code) for r in issues if r.sample_id == s} == expected


def test_document_form_equals_fold(spark):
    points, edges, raw = random_tables(spark)
    check(N.normalize_tables(points, edges), raw)


def test_table_form_equals_fold(spark):
    points, edges, raw = random_tables(spark, seed=11)
    check(N.normalize_large(points, edges), raw)


@pytest.mark.parametrize("limit", [0, 12, 30])
def test_table_form_of_samples_above_and_below_a_range_equals_fold(spark, limit):
    """Windows for the samples that a range could hold, ranges and joins for the others."""
    points, edges, raw = random_tables(spark, seed=13, samples=40)
    check(N.normalize_large(points, edges, limit), raw)


def test_table_form_sends_rows_of_small_samples_once_a_step(spark, monkeypatch):
    """No step of many small samples is range-partitioned, and links meet the ids of their ends without a join."""
    from annograph.plans import skew

    monkeypatch.setattr(skew, "RANGE_ROWS", 50)
    written = []
    kept = N.materialize

    def watched(df, label="stage"):
        written.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return kept(df, label)

    monkeypatch.setattr(N, "materialize", watched)
    monkeypatch.setattr(skew, "materialize", watched)
    points, edges, raw = random_tables(spark, seed=17, samples=30)
    check(N.normalize_large(points, edges), raw)
    assert not any(label in ("rows", "ranges") for label, _ in written)
    assert not any("Join" in plan for _, plan in written)


def test_large_samples_take_the_table_form_and_nothing_is_lost(spark):
    points, edges, raw = random_tables(spark, seed=3, samples=40)
    check(N.normalize_tables(points, edges, limit=20), raw)


def test_id_chain_settles_in_few_rounds(spark):
    ids = [0, 0, *range(1, 3000)]
    rows = spark.createDataFrame([(1, p, True, i, 0.0, 0.0, 1.0, "m") for p, i in enumerate(ids)], POINTS)
    got = {r.pos: r.given for r in N.assign_ids_by_scan(rows).collect()}
    assert [got[p] for p in range(len(ids))] == fold(ids)


def test_one_sample_with_a_third_of_all_rows(spark):
    """A sample over the row limit and over one bucket of 2^16 positions, in both ids and links."""
    n = 70_000
    big = spark.range(n).select(
        F.lit(0).cast("long").alias("sample_id"), F.col("id").cast("int").alias("pos"), F.lit(True).alias("is_object"),
        F.when(F.col("id") % 1000 == 999, 5).otherwise(F.col("id") * 3).cast("int").alias("id"), F.col("id").cast("double").alias("x"),
        F.lit(0.0).alias("y"), F.lit(1.0).alias("score"), F.lit("m").alias("source"),
    )
    links = spark.range(n).select(
        F.lit(0).cast("long").alias("sample_id"), F.col("id").cast("int").alias("pos"), F.lit(True).alias("is_object"), F.lit(None).cast("string").alias("edge_id"),
        F.lit(0).alias("src"), ((F.col("id") % 50_000) * 3).cast("int").alias("dst"), F.lit(1).alias("label"), F.lit("m").alias("source"),
    )
    norm = N.normalize_tables(big, links)
    given = fold([5 if p % 1000 == 999 else p * 3 for p in range(n)])
    kept, codes = link_fold(given, [(0, (p % 50_000) * 3) for p in range(100)])
    stats = table_stats(norm, norm.points.select("sample_id").distinct()).first()
    dense = {g: i for i, g in enumerate(sorted(given))}
    known = {dense[d * 3] for d in range(50_000) if d * 3 in dense} - {0}
    assert (stats.point_count, stats.edge_count) == (n, len(known))
    assert {(r.src, r.dst) for r in norm.edges.where("dst < 90").collect()} == {k for k in kept if k[1] < 90}
    assert norm.points.where("x = 69999").first().id == dense[given[69999]]
    assert (stats.overflow_count, stats.overflow_shown) == (1, "0")


def documents(spark, *raw):
    return spark.createDataFrame([(f"a/s{i}.json", f"s{i}", r) for i, r in enumerate(raw)], "path string, stem string, raw string")


def codes(row):
    return [i.code for i in row.issues]


def test_literal_documents(spark):
    out = N.normalize_rows(parse_annotations(documents(
        spark,
        '{"image_path":"plate.png","points":[{"id":0,"x":11,"y":6},{"id":1,"x":8,"y":17}],"edges":[{"src":0,"dst":1}]}',
        '{"image_path":"plate.png","points":[{"id":0,"x":1,"y":2},{"id":0,"x":3,"y":4}]}',
        '{"image_path":"plate.png","points":[{"id":0,"x":1,"y":2}],"edges":[{"src":0,"dst":57}]}',
        '{"image_path":"plate.png","points":[{"id":0,"x":1,"y":2}],"edges":[{"src":0,"dst":0}]}',
        '{"image_path":"plate.png","points":[{"id":0,"x":1,"y":2},{"id":1,"x":1,"y":2}],"edges":[{"src":0,"dst":1},{"src":1,"dst":0}]}',
        '{"points":[]}',
        '"only a text"',
        '{"image_path":"plate.png","points":[3,{"x":1},{"id":null,"x":1,"y":1},{"x":"2","y":3,"score":null}],"edges":[[],{"src":0}]}',
        '{"shapes":[{"label":"sew","shape_type":"point","points":[[7.25,31.5]],"score":0.8},{"label":"keypoint","shape_type":"point","points":[[12,9]]},'
        '{"label":"sew","shape_type":"rectangle","points":[[1,2]]}],"imagePath":"old.png","imageWidth":410,"imageHeight":260}',
        '{"shapes": [',
    ))).orderBy(F.col("json_path")).collect()
    assert [len(r.points) for r in out] == [2, 2, 1, 1, 2, 0, 0, 1, 2, 0]
    assert [len(r.edges) for r in out] == [1, 0, 0, 0, 1, 0, 0, 0, 0, 0]
    assert codes(out[0]) == []
    assert codes(out[1]) == ["POINT_ID_DUP"] and [p.id for p in out[1].points] == [0, 1]
    assert codes(out[2]) == ["EDGE_DANGLING"] and codes(out[3]) == ["EDGE_SELF_LOOP"] and codes(out[4]) == ["EDGE_DUP"]
    assert codes(out[5]) == ["IMAGE_PATH_BACKFILLED"] and out[5].image_path == "s5.png"
    assert out[6].readable and not out[6].is_object
    assert codes(out[7]) == ["POINT_NOT_OBJECT", "POINT_INVALID", "POINT_INVALID", "VALUE_INVALID", "EDGE_NOT_OBJECT", "EDGE_INVALID"]
    assert (out[8].width, out[8].height) == (410, 260) and [p.score for p in out[8].points] == [0.8, 1.0]
    assert out[8].points[0].source == "labelme_point" and "labelme_point" in out[8].metadata.toJson()
    assert not out[9].readable


def test_normalisation_is_idempotent(spark):
    points, edges, _ = random_tables(spark, seed=5, samples=30)
    once = N.normalize_tables(points, edges)
    flag = F.lit(True).alias("is_object")
    again = N.normalize_tables(
        once.points.select("sample_id", F.col("id").alias("pos"), flag, "id", "x", "y", "score", "source"),
        once.edges.select("sample_id", F.substring("edge_id", 6, 9).cast("int").alias("pos"), flag, "edge_id", "src", "dst", "label", "source"),
    )
    assert sorted(again.points.collect()) == sorted(once.points.collect())
    assert sorted(again.edges.collect()) == sorted(once.edges.collect())
    assert again.issues.count() == 0


def test_degree_overflow(spark):
    links = [(1, p, True, None, 0, p + 1, 1, "m") for p in range(3)]
    points = [(1, p, True, p, 0.0, 0.0, 1.0, "m") for p in range(4)]
    docs = N.normalize_documents(N.group_documents(spark.createDataFrame(points, POINTS), spark.createDataFrame(links, EDGES)))
    row = document_stats(docs).first()
    assert (row.overflow_count, row.overflow_shown) == (1, "0")


def test_review_clean_up(spark):
    links = [(1, p, True, None, a, b, None, None) for p, (a, b) in enumerate([(0, 1), (1, 0), (0, 0), (-1, 1)])]
    out = N.clean_edges(spark.createDataFrame(links, EDGES)).collect()
    assert [(r.edge_id, r.src, r.dst, r.label, r.source) for r in out] == [("edge_0001", 0, 1, 1, "manual")]


def test_ids_beyond_32_bits(spark):
    """Large ids are kept, and a repeat of the largest one does not end the job; both forms agree."""
    top = 2**31 - 1
    ids, links = [3_000_000_000, top, top, 5], [(3_000_000_000, top), (5, 3_000_000_001), (1, top)]
    raw = json.dumps({"points": [{"id": i, "x": n, "y": n} for n, i in enumerate(ids)], "edges": [{"src": a, "dst": b} for a, b in links]})
    repeated = raw[:-1] + ', "image_path": "a.png", "image_path": "b.png"}'
    parsed = parse_annotations(spark.createDataFrame([("p/s.json", "s", repeated)], "path string, stem string, raw string"))
    row = N.normalize_rows(parsed).first()
    assert row.image_path == "b.png"
    assert [(p.id, p.x) for p in row.points] == [(0, 3.0), (1, 1.0), (2, 0.0), (3, 2.0)]
    assert [(e.src, e.dst) for e in row.edges] == [(1, 2), (0, 3)]
    points = parsed.select("sample_id", F.inline("raw_points"))
    edges = parsed.select("sample_id", F.inline("raw_edges"))
    large = N.normalize_large(points, edges)
    assert sorted((p.id, p.x) for p in large.points.collect()) == [(0, 3.0), (1, 1.0), (2, 0.0), (3, 2.0)]
    assert sorted((e.src, e.dst) for e in large.edges.collect()) == [(0, 3), (1, 2)]
    assert {i.code for i in large.issues.collect()} == {i.code for i in row.issues} == {"POINT_ID_DUP", "EDGE_DANGLING"}


def mixed_documents(spark, seed=23):
    """Documents with broken elements of every kind, as parsed rows."""
    rng = random.Random(seed)
    texts = []
    for n in range(60):
        ids = rng.choice([3, 10, 60])
        point = lambda: rng.choice([7, None, {"x": 1}, {"id": "q", "x": 1, "y": 2}] + [{"id": rng.randint(-2, ids), "x": rng.random(), "y": 2, **rng.choice([{}, {"score": None}, {"score": 0.5, "source": "s"}])}] * 9)
        link = lambda: rng.choice([5, {"src": 1}] + [{"src": rng.randint(-2, ids), "dst": rng.randint(-2, ids), **rng.choice([{}, {"label": "x"}, {"label": 3, "edge_id": ""}, {"edge_id": "mine"}])}] * 9)
        texts.append((f"p/{n}.json", str(n), json.dumps({"points": [point() for _ in range(rng.randint(0, 40))], "edges": [link() for _ in range(rng.randint(0, 60))]})))
    return parse_annotations(spark.createDataFrame(texts, "path string, stem string, raw string")).where(F.lit(True))


@pytest.mark.parametrize("detail", ["messages", "codes", "none"])
def test_sorted_form_equals_the_column_form(spark, detail):
    docs = mixed_documents(spark).select("sample_id", "raw_points", "raw_edges")
    rows = lambda long: {r.sample_id: (r.points, r.edges, r.issues) for r in N.normalize_documents(docs, detail, long).collect()}
    one = rows(None)
    assert rows(0) == one == rows(20)
    assert detail == "none" or {i.code for r in one.values() for i in r[2]} >= {"POINT_NOT_OBJECT", "POINT_INVALID", "POINT_ID_DUP", "VALUE_INVALID", "EDGE_NOT_OBJECT", "EDGE_INVALID", "EDGE_DANGLING", "EDGE_SELF_LOOP", "EDGE_DUP"}


@pytest.mark.parametrize("detail", ["messages", "codes", "none"])
def test_batches_equal_the_column_form(spark, monkeypatch, detail):
    """Documents of a batch do not meet one another; unknown links stay unknown. Without a bound no column expressions are used."""
    docs = mixed_documents(spark, 31).select("sample_id", "raw_points", F.when(F.col("sample_id") != "7", F.col("raw_edges")).alias("raw_edges"))
    rows = lambda long: {r.sample_id: (r.points, r.edges, r.issues) for r in N.normalize_documents(docs, detail, long).collect()}
    columns = rows(10**6)

    def refuse(*args):
        raise AssertionError("column expressions")

    monkeypatch.setattr(N, "_graph_rules", refuse)
    assert rows(None) == columns
    assert columns["7"][1] is None and (columns["7"][2] is None) == (detail != "none")


def test_elements_are_read_in_one_go(spark):
    """Absent, null, unreadable and foreign elements and members keep their readings."""
    text = '{"points":[{"id":null,"x":"3","y":1,"score":null},{"X":1,"id":"q"},null,[1],{"x":{},"y":true,"source":5,"id":2.0}],"edges":[{"src":"1","dst":2,"label":null},"a",{"label":"z","edge_id":7}]}'
    plan = parse_annotations(spark.createDataFrame([("p/s.json", "s", text)], "path string, stem string, raw string"))
    row = plan.first()
    assert [(p.pos, p.is_object, p.id, p.x, p.y, p.score, p.source) for p in row.raw_points] == [
        (0, True, None, 3.0, 1.0, None, "manual"), (1, True, None, None, None, 1.0, "manual"), (2, False, 2, None, None, 1.0, "manual"),
        (3, False, 3, None, None, 1.0, "manual"), (4, True, 2, None, 1.0, 1.0, "5"),
    ]
    assert [(e.pos, e.is_object, e.edge_id, e.src, e.dst, e.label, e.source) for e in row.raw_edges] == [
        (0, True, None, 1, 2, None, "manual"), (1, False, None, None, None, 1, "manual"), (2, True, "7", None, None, None, "manual"),
    ]


def test_document_rows_have_all_sizes(spark):
    points, edges, raw = random_tables(spark, seed=5, samples=40)
    plain = {r.sample_id: (r.points, r.edges) for r in N.document_rows(points, edges).collect()}
    assert plain == {r.sample_id: (r.points, r.edges) for r in N.document_rows(points, edges, limit=10).collect()}
    assert set(plain) == set(raw)


def test_long_document_is_normalised_in_its_row(spark):
    n = 300_000
    text = json.dumps({"points": [{"id": i // 2, "x": i, "y": 0} for i in range(n)], "edges": [{"src": i, "dst": i + 1} for i in range(n)]})
    row = N.normalize_rows(parse_annotations(spark.createDataFrame([("p/s.json", "s", text)], "path string, stem string, raw string")), "codes").select(
        F.size("points").alias("p"), F.size("edges").alias("e"), F.size("issues").alias("i"), F.col("points")[0]["x"].alias("x"), F.col("edges")[n - 3]["edge_id"].alias("name")
    ).first()
    given = fold([i // 2 for i in range(n)])
    kept, codes = len({(i, i + 1) for i in range(n)} & {(i, i + 1) for i in range(max(given))}), n - max(given)
    assert (row.p, row.e) == (n, kept) and row.x == 0.0 and row.name == f"edge_{n - 2:04d}"
    assert row.i == sum(g != i // 2 for i, g in enumerate(given)) + codes + 1
