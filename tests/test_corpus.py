"""Planning, naming, files, pixels, sinks and intake on small literal inputs."""

import json
import os
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annograph.functions.text import output_path, stem_of, suffix_of
from annograph.operators import corpus as C, pairing
from annograph.operators.edits import nearest_point
from annograph.operators.evaluate import classify_edges
from annograph.plans import skew
from annograph.plans.skew import rank_rows, running
from annograph.sinks import writers
from annograph.sources import annotations as S, images as I
from annograph.sources.pixels import png_bytes
from annograph.streaming import intake


def sizes(spark, w, h):
    return spark.createDataFrame([("d/a.b.png", w, h)], "path string, width int, height int")


def tiles(df):
    return sorted((r.row, r.col, r.x, r.y, r.w, r.h) for r in df.collect())


def test_tile_grids(spark):
    assert tiles(C.tile_grid(sizes(spark, 512, 512), 256, 256))[-1] == (1, 1, 256, 256, 256, 256)
    assert [t[2:4] for t in tiles(C.tile_grid(sizes(spark, 300, 300), 256, 256))] == [(0, 0), (44, 0), (0, 44), (44, 44)]
    assert tiles(C.tile_grid(sizes(spark, 200, 200), 256, 256)) == [(0, 0, 0, 0, 256, 256)]
    plan = C.tile_plan(sizes(spark, 300, 300), 256, 256, allow_overlap=False).collect()
    assert [r.out_name for r in plan] == ["a.b_tile_0_0.png"]


def test_crops(spark):
    row = C.crop_plan(sizes(spark, 200, 160), [(10, 10, 50, 40), (300, 0, 400, 9)], 100, 80).collect()
    assert [(r.x2 - r.x1, r.y2 - r.y1, r.out_name) for r in row] == [(80, 60, "a.b_roi_1.png")]
    assert C.crop_plan(sizes(spark, 200, 160), [(1, 1, 2, 2)], 0, 80).count() == 0


def test_sliding_windows_end_flush(spark):
    got = sorted((r.y0, r.x0) for r in C.sliding_windows(sizes(spark, 500, 256), 256, 192).collect())
    assert got == [(0, 0), (0, 192), (0, 244)]


def test_resize(spark):
    one = lambda **k: tuple(C.resize_plan(sizes(spark, 200, 100), **k).first()[3:])
    assert one(width=100) == (100, 50) and one(height=50) == (100, 50) and one(scale=0.5) == (100, 50)
    assert one(width=100, height=100) == (100, 50) and one(width=100, height=100, keep_aspect=False) == (100, 100)
    assert one(scale=-1.0) == (200, 100) and one(width=-5, height=10) == (200, 100)


def test_keywords(spark):
    files = spark.createDataFrame([("d/top_001.png",), ("d/bottom_001.jpg",), ("d/TOP_002.PNG",), ("d/unknown.png",), ("d/notes.txt",)], "path string")
    counts = {r.keyword: r.n for r in C.keyword_counts(C.image_files(files), ["top", "bottom", "never"]).collect()}
    assert counts == {"top": 2, "bottom": 1, "never": 0, "_unsorted": 1}


def test_paths(spark):
    df = spark.createDataFrame([("/input/img.png",), ("e.v2.png",), (".hidden",), ("a\\b.c",)], "p string")
    got = df.select(stem_of(F.col("p")).alias("s"), suffix_of(F.col("p")).alias("t"), output_path(F.col("p"), "/output", "_r", ".jpg").alias("o")).collect()
    assert [(r.s, r.t) for r in got] == [("img", ".png"), ("e.v2", ".png"), (".hidden", ""), ("b", ".c")]
    assert got[0].o == "/output/img_r.jpg"


def name_fold(names, taken):
    taken, out = set(taken), []
    for name in names:
        stem, dot, tail = name.rpartition(".")
        target, n = name, 0
        while target in taken:
            n += 1
            target = f"{stem}_{n}{dot}{tail}"
        taken.add(target)
        out.append(target)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unique_names_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    pool = ["x.png", "x_1.png", "x_2.png", "x_1_1.png", "y.png", "y_3.png", "x_10.png"]
    names = [rng.choice(pool) for _ in range(25)]
    taken = rng.sample(["x.png", "x_1.png", "x_3.png", "y_1.png", "z.png", "x_1_2.png"], 3)
    incoming = spark.createDataFrame(list(enumerate(names)), "seq int, name string")
    got = C.unique_names(incoming, spark.createDataFrame([(t,) for t in taken], "name string"))
    assert [r.target for r in got.orderBy("seq").collect()] == name_fold(names, taken)


def test_running_totals_cross_buckets(spark):
    rows = spark.range(300_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("int").alias("k"), (F.col("id") % 7).alias("v"))
    out = running(rows, ["g"], "k", [("total", "sum", F.col("v"), True), ("before", "max", F.col("v"), False)])
    last = out.where("k = 299999").first()
    assert last.total == sum(i % 7 for i in range(1, 300_000, 2)) and last.before == 6
    assert out.where("k = 0").first().before is None
    ranked = rank_rows(rows, ["g"], ["k"], "n", limit=10)
    assert ranked.where("n <> shiftright(k, 1) + 1").count() == 0 and ranked.count() == 300_000


def test_running_totals_of_small_and_large_groups(spark, monkeypatch):
    """Groups that fit a range and groups that do not, a null group among either."""
    monkeypatch.setattr(skew, "RANGE_ROWS", 100)
    for null_rows in (30, 400):
        sizes = {None: null_rows, "a": 20, "b": 1000, "c": 100, "d": 101}
        rows = spark.createDataFrame([(g, k) for g, n in sizes.items() for k in range(n)], "g string, k int")
        got = skew.running(rows, ["g"], "k", [("n", "sum", F.lit(1), True), ("before", "max", F.col("k"), False)])
        assert got.where("n <> k + 1 or not before <=> if(k = 0, null, k - 1)").count() == 0
        assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == sizes


def test_running_totals_of_one_key_and_of_an_outlier(spark, monkeypatch):
    """Neither rows of one key and no other difference nor a far value put more rows into a range than the others hold."""
    monkeypatch.setattr(skew, "RANGE_ROWS", 5_000)
    sizes = []
    kept = skew.materialize

    def watched(df, label):
        out = kept(df, label)
        if label == "ranges":
            sizes.extend(r["count"] for r in out.groupBy("__range").count().collect())
        return out

    monkeypatch.setattr(skew, "materialize", watched)
    same = spark.range(60_000).select(F.lit("g").alias("g"), F.lit(None).cast("int").alias("k"))
    ranked = rank_rows(same, ["g"], ["k"], "n", limit=10)
    assert ranked.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()[:] == (1, 60_000, 60_000)
    far = spark.range(60_000).select(F.lit(None).cast("string").alias("g"), F.when(F.col("id") == 7, 1e300).otherwise(F.col("id") / 1e6).alias("k"))
    got = skew.running(far, ["g"], "k", [("n", "sum", F.lit(1), True), ("before", "max", F.col("k"), False)])
    assert got.where("n <> round(k * 1e6) + if(k < 7e-6, 1, 0) and k < 1").count() == 0
    last = got.where("k > 1").first()
    assert last.n == 60_000 and last.before == 0.059999
    assert len(sizes) >= 20 and max(sizes) < 10_000
    assert rank_rows(same.where("false"), ["g"], ["k"], "n").count() == 0


def test_many_taken_numbers_of_one_name(spark):
    """A name whose numbered forms arrive as names of their own, before and after it, equals the fold."""
    rng = random.Random(11)
    names = ["x.png" if rng.random() < 0.6 else f"x_{rng.randint(1, 30)}.png" for _ in range(60)]
    incoming = spark.createDataFrame([((1 << 40) + i, n) for i, n in enumerate(names)], "seq bigint, name string")
    got = C.unique_names(incoming, spark.createDataFrame([("x_2.png",)], "name string"))
    assert [r.target for r in got.orderBy("seq").collect()] == name_fold(names, ["x_2.png"])


def test_nearest_point(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 0.0)], "sample_id int, id int, x double, y double")
    clicks = spark.createDataFrame([(1, 0, 9.0, 0.0), (1, 1, 50.0, 50.0)], "sample_id int, click int, qx double, qy double")
    assert [(r.click, r.id, r.d) for r in nearest_point(points, clicks, 14.0).collect()] == [(0, 1, 1.0)]


def test_nearest_point_sends_clicks_of_small_samples_once(spark):
    """Samples below and above the limit equal brute force; clicks of the former are not multiplied."""
    rng = random.Random(3)
    spots = [(s, i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for s in range(6) for i in range(3 + 10 * (s % 2))]
    asked = [(s, c, rng.uniform(-50, 50), rng.uniform(-50, 50)) for s in range(7) for c in range(20)]
    points = spark.createDataFrame([*spots, (None, 0, 0.0, 0.0)], "sample_id int, id int, x double, y double")
    clicks = spark.createDataFrame([*asked, (None, 0, 0.0, 0.0)], "sample_id int, click int, qx double, qy double")
    best = {}
    for s, c, qx, qy in asked:
        near = [(math.hypot(x - qx, y - qy), i) for t, i, x, y in spots if t == s and math.hypot(x - qx, y - qy) <= 15.0]
        if near:
            best[s, c] = min(near)[1]
    for limit in (0, 5, 64):
        assert {(r.sample_id, r.click): r.id for r in nearest_point(points, clicks, 15.0, limit).collect()} == best
    assert "Generate" not in nearest_point(points, clicks, 15.0)._jdf.queryExecution().optimizedPlan().toString()


def test_edge_classes_need_one_shuffle(spark):
    """Both sides meet in one aggregate; links without a sample equal nothing."""
    shape = "sample_id int, src int, dst int"
    predicted = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 3), (1, 4, 4), (1, None, 2), (None, 0, 1), (None, 1, 0)], shape)
    truth = spark.createDataFrame([(1, 1, 0), (1, 5, 6), (None, 0, 1)], shape)
    out = classify_edges(predicted, truth)
    got = sorted((r.sample_id or 0, r.u, r.v, r["class"]) for r in out.collect())
    assert got == [(0, 0, 1, "FN"), (0, 0, 1, "FP"), (1, 0, 1, "TP"), (1, 2, 3, "FP"), (1, 5, 6, "FN")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_review_items(spark):
    images = spark.createDataFrame([("keep", "i/keep.png"), ("skip", "i/skip.png")], "stem string, path string")
    labels = spark.createDataFrame([("keep", "i/keep.json")], "stem string, path string")
    assert pairing.filter_items(images, labels).count() == 1
    assert pairing.label_counts(pairing.filter_items(images, labels, False)).first()[:] == (1, 1)


def pixels(h, w, c=3, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)


def test_image_files_on_disk(spark, tmp_path):
    image = pixels(80, 120)
    (tmp_path / "a b.PNG").write_bytes(png_bytes(image))
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    (tmp_path / "n.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.png").write_bytes(png_bytes(image))
    assert sorted(r.stem for r in I.read_images(spark, str(tmp_path)).collect()) == ["a b", "bad"]
    assert I.read_images(spark, str(tmp_path), recursive=True).count() == 3
    assert I.read_images(spark, str(tmp_path / "sub" / "c.png")).count() == 1
    known = {r.stem: (r.width, r.height) for r in I.image_sizes(spark, str(tmp_path)).collect() if r.suffix != ".txt"}
    assert known == {"a b": (120, 80), "bad": (None, None)}
    heads = {r.stem: (r.width, r.height, r.channels, r.orientation) for r in I.image_headers(I.read_images(spark, str(tmp_path), content=True)).collect()}
    assert heads == {"a b": (120, 80, 3, 0), "bad": (None, None, None, 0)}
    decoded = spark.read.format("image").load(str(tmp_path / "a b.PNG")).select("image.data", "image.nChannels").first()
    assert np.array_equal(np.frombuffer(decoded.data, np.uint8).reshape(80, 120, decoded.nChannels), image)
    with pytest.raises(Exception):
        I.read_images(spark, str(tmp_path / "none")).count()


@pytest.mark.parametrize("tag", range(1, 9))
def test_orientation(tag):
    image = pixels(2, 3)
    out = I.oriented(image, tag)
    assert out.shape[:2] == ((3, 2) if tag >= 5 else (2, 3))
    # tags 5 and 7: quarter turn, then mirrored left to right
    corner = {1: (0, 0), 2: (0, -1), 3: (-1, -1), 4: (-1, 0), 5: (-1, -1), 6: (0, -1), 7: (0, 0), 8: (-1, 0)}[tag]
    assert np.array_equal(out[corner], image[0, 0])


def test_crop_pixels(spark):
    image = pixels(6, 5)
    images = spark.createDataFrame([("p", 6, 5, 3, bytearray(image.tobytes()), 6)], "path string, height int, width int, channels int, data binary, orientation int")
    plan = spark.createDataFrame([("p", "o.png", 1, 2, 3, 2)], "path string, out_name string, x int, y int, w int, h int")
    r = I.crop_pixels(images, plan).first()
    expected = np.rot90(image, 3)[2:4, 1:4]
    assert np.array_equal(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels), expected)


def test_strip_samples_are_exact_on_axis():
    image = pixels(20, 30)
    strip = I.sample_strip(image, 2, 3, 9, 3, 2, 6, 8, 4)
    assert np.allclose(strip, image[3:7, 2:10] / 255.0, atol=1e-6)
    outside = I.sample_strip(image, -2, 0, 1, 0, -2, 1, 4, 2)
    assert np.allclose(outside[0], image[0, [2, 1, 0, 1]] / 255.0, atol=1e-6)


def test_annotation_folder_and_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"points":[]}')
    (tmp_path / "B.JSON").write_text("{}")
    (tmp_path / ".c.json").write_text("{}")
    assert sorted(r.stem for r in S.read_annotations(spark, str(tmp_path)).collect()) == ["B", "a"]
    assert [r.stem for r in S.read_annotations(spark, str(tmp_path), case_sensitive=True).collect()] == ["a"]
    docs = spark.createDataFrame([("x/é.json", '{"k":"é"}')], "json_dst string, body string")
    writers.write_annotations(docs, str(tmp_path / "out"), "files")
    text = (tmp_path / "out" / "x" / "é.json").read_text(encoding="utf-8")
    assert json.loads(text) == {"k": "é"} and text.startswith("{\n  ")


def test_copies_skip_existing_targets(spark, tmp_path):
    (tmp_path / "s1").write_text("new")
    (tmp_path / "s2").write_text("new")
    (tmp_path / "d2").write_text("old")
    plan = spark.createDataFrame([(str(tmp_path / f"s{i}"), str(tmp_path / f"d{i}")) for i in (1, 2)], "src string, dst string")
    writers.copy_files(plan)
    assert (tmp_path / "d1").read_text() == "new" and (tmp_path / "d2").read_text() == "old"


def test_intake_sees_each_file_once(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    good = '{"image_path":"i.png","points":[{"id":0,"x":1,"y":2}]}'
    (box / "a.json").write_text(good)
    (box / "b.json").write_text("{broken")
    seen = []
    run = lambda: intake.run_intake(spark, str(box), str(tmp_path / "out"), str(tmp_path / "state"), lambda b, i: seen.append(b.count()))
    run()
    (box / "c.json").write_text(good)
    run()
    assert sum(seen) == 3
    routes = {r.sample_id: r.route for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert routes == {"a": "ok", "b": "error", "c": "ok"}


def test_repeated_content_is_dropped(spark, tmp_path):
    box = tmp_path / "img"
    box.mkdir()
    run = lambda: intake.run_distinct_content(intake.image_stream(spark, str(box)), str(tmp_path / "out"), str(tmp_path / "state"))
    for name, body in (("a.png", b"1"), ("b.png", b"1"), ("c.png", b"2")):
        (box / name).write_bytes(body)
    run()
    for name, body in (("late.png", b"3"), ("again.png", b"2")):
        (box / name).write_bytes(body)
        os.utime(box / name, (1_000_000, 1_000_000))  # a copy that kept its old time
    run()
    stems = sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(stems) == 3 and stems[1:] == ["c.png", "late.png"]


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(bytes([0xFF, m]) + (len(p) + 2).to_bytes(2, "big") + p for m, p in segments) + b"\xff\xda\0\2"


def exif(order, tag):
    number = lambda v, n: v.to_bytes(n, order)
    entry = number(0x0112, 2) + number(3, 2) + number(1, 4) + number(tag, 2) + b"\0\0"
    return b"Exif\0\0" + {"little": b"II", "big": b"MM"}[order] + number(42, 2) + number(8, 4) + number(1, 2) + entry + number(0, 4)


FRAME = b"\x08" + (48).to_bytes(2, "big") + (64).to_bytes(2, "big") + b"\x03" + b"\0" * 9
WIDE = (299).to_bytes(3, "little") + (149).to_bytes(3, "little")


@pytest.mark.parametrize(
    "data, size, orientation",
    [
        (jpeg((0xE0, b"x" * 20), (0xC0, FRAME)), (64, 48, 3), 0),
        (jpeg((0xE1, exif("little", 6)), (0xC2, FRAME)), (64, 48, 3), 6),
        (jpeg((0xE1, exif("big", 3)), (0xC4, b"y" * 30), (0xC1, FRAME)), (64, 48, 3), 3),
        (jpeg((0xE1, b"http://other"), (0xE1, exif("big", 3))), None, 0),
        (b"\xff\xd8\xff\xff\xff\xc0" + (17).to_bytes(2, "big") + FRAME, (64, 48, 3), 0),
        (b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\x10\0\0\0" + WIDE, (300, 150, 4), 0),
        (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0/" + (299 | 149 << 14).to_bytes(4, "little"), (300, 150, 3), 0),
        (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0abc\x9d\x01*" + (300).to_bytes(2, "little") + (150).to_bytes(2, "little"), (300, 150, 3), 0),
        (b"BM" + b"\0" * 12 + (40).to_bytes(4, "little") + (7).to_bytes(4, "little") + (-5).to_bytes(4, "little", signed=True) + b"\1\0\x18\0", (7, 5, 3), 0),
        (b"MM\0*\0\0\0\x08\0\2" + b"\1\0\0\3\0\0\0\1\0\x11\0\0" + b"\1\1\0\4\0\0\0\1\0\0\0\x21", (17, 33, 1), 0),
        (b"\xff\xd8\xff\xc0", None, 0), (b"RIFF", None, 0), (b"", None, 0),
    ],
)
def test_headers(data, size, orientation):
    assert I.header_info(data) == size
    assert I.exif_orientation(data) == orientation


def test_header_behind_the_head(spark):
    data = jpeg(*[(0xE2, b"p" * 60_000)] * 3, (0xC0, FRAME))
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"no image" * 20_000))], "path string, content binary")
    assert sorted(tuple(r) for r in I.image_headers(files).collect()) == [("a", 64, 48, 3, 0), ("b", None, None, None, 0)]


def test_sizes_of_files_without_a_decoder(spark, tmp_path):
    (tmp_path / "w.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\x10\0\0\0" + WIDE)
    assert [(r.stem, r.width, r.height, r.channels) for r in I.image_sizes(spark, str(tmp_path)).collect()] == [("w", 300, 150, 4)]


def test_only_ranges_of_files_are_read(spark, tmp_path):
    """Headers at the front, behind long segments and at the end of files of 5 MB."""
    directory = b"\0\2" + b"\1\0\0\3\0\0\0\1\0\x11\0\0" + b"\1\1\0\4\0\0\0\1\0\0\0\x21"
    long = {
        "far.jpg": jpeg(*[(0xE2, b"p" * 60_000)] * 8, (0xC0, FRAME)) + b"\0" * 5_000_000,
        "end.tif": b"MM\0*" + (5_000_008).to_bytes(4, "big") + b"\0" * 5_000_000 + directory,
        "g.gif": b"GIF89a" + (9).to_bytes(2, "little") + (8).to_bytes(2, "little") + b"\0" * 5_000_000,
        "cut.png": png_bytes(pixels(80, 120))[:40],
        "none.png": b"no image" * 600_000,
        "short.bmp": b"BM",
    }
    for name, data in long.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/")[-1]: r for r in I.ranged_headers(I.read_images(spark, str(tmp_path), suffixes=(".jpg", ".tif", ".gif", ".png", ".bmp")).drop("modificationTime")).collect()}
    size = lambda n: (got[n].width, got[n].height, got[n].channels)
    assert [size(n) for n in long] == [(64, 48, 3), (17, 33, 1), (9, 8, 3), (120, 80, 3), (None,) * 3, (None,) * 3]
    assert all(r.bytes_read <= 10 * I.PAGE for r in got.values()) and got["none.png"].bytes_read == I.PAGE
    whole = I.image_headers(I.read_images(spark, str(tmp_path), suffixes=(".jpg", ".tif"), content=True))
    assert sorted((r.width, r.height) for r in whole.collect()) == [(17, 33), (64, 48)]
    assert sorted((r.stem, r.width) for r in I.image_sizes(spark, str(tmp_path)).where("suffix <> '.jpg'").collect()) == [("cut", 120), ("end", 17), ("g", 9), ("none", None), ("short", None)]
