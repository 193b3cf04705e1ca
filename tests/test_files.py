"""Files as a sink: all or none, whatever happens to tasks."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annograph.sinks import files, writers


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), encoding="utf-8").read() for d, _, names in os.walk(root) for n in names if not n.endswith(".crc")}


def bodies(spark, n=40):
    return spark.range(n, numPartitions=6).select(F.concat(F.lit("a/"), F.col("id") % 3, F.lit("/ü "), "id", F.lit(".json")).alias("json_dst"), F.concat(F.lit('{"n":'), "id", F.lit(',"t":"é"}')).alias("body"))


def test_documents_as_files(spark, tmp_path):
    writers.write_annotations(bodies(spark), f"file://{tmp_path}/out", "files")
    got = tree(tmp_path / "out")
    assert set(got) == {f"a/{n % 3}/ü {n}.json" for n in range(40)}
    assert got["a/1/ü 7.json"] == json.dumps({"n": 7, "t": "é"}, ensure_ascii=False, indent=2)
    assert not [n for n in os.listdir(tmp_path / "out") if n.startswith("_")]
    writers.write_annotations(bodies(spark, 1).withColumn("body", F.lit("5")), str(tmp_path / "out"), "files")
    assert tree(tmp_path / "out") == {**got, "a/0/ü 0.json": "5"}


def test_failed_job_leaves_nothing(spark, tmp_path):
    broken = bodies(spark).withColumn("body", F.when(F.col("json_dst").endswith("33.json"), "{").otherwise(F.col("body")))
    with pytest.raises(Exception, match="Expecting property name"):
        writers.write_annotations(broken, str(tmp_path / "out"), "files")
    assert tree(tmp_path / "out") == {}


def test_retried_task_counts_once(tmp_path):
    writer = files.FileWriter({"path": str(tmp_path / "out"), "name": "n", "body": "b", "overwrite": "true"})
    batch = lambda rows: pa.RecordBatch.from_pydict({"n": [r[0] for r in rows], "b": [r[1] for r in rows]})

    def lost():
        yield batch([("x", "first try"), ("only-first-try", "y")])
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(lost())
    twin = writer.write(iter([batch([("x", "speculative"), ("z", "speculative")])]))
    good = writer.write(iter([batch([("x", "second try")]), batch([("z", "last")])]))
    assert twin.folder != good.folder and good.files == 2
    assert not os.path.exists(tmp_path / "out" / "x")
    writer.commit([good, None])
    assert tree(tmp_path / "out") == {"x": "second try", "z": "last"}


def test_copies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(5):
        (tmp_path / "in" / f"s {n}%20").write_bytes(bytes([n]) * 3_000_000)
    (tmp_path / "out" / "deep").mkdir(parents=True)
    (tmp_path / "out" / "deep" / "d1").write_text("old")
    rows = [(f"file:{tmp_path}/in/s {n}%20", f"{tmp_path}/out/deep/d{n}") for n in range(5)] + [(None, "x"), ("x", None)]
    plan = spark.createDataFrame(rows, "src string, dst string")
    writers.copy_files(plan)
    size = lambda n: os.path.getsize(tmp_path / "out" / "deep" / f"d{n}")
    assert [size(n) for n in range(5)] == [3_000_000, 3, *[3_000_000] * 3]
    writers.copy_files(plan.where("dst like '%d1'"), overwrite=True)
    assert size(1) == 3_000_000 and os.path.exists(tmp_path / "in" / "s 1%20")
    with pytest.raises(Exception):
        writers.copy_files(spark.createDataFrame([(f"{tmp_path}/in/s 0%20", f"{tmp_path}/new/a"), (f"{tmp_path}/in/gone", f"{tmp_path}/new/b")], "src string, dst string"))
    assert not os.path.exists(tmp_path / "new" / "a")
    writers.copy_files(plan.where("false"))


def test_paths_of_file_systems():
    assert files.locate("file:///a/b c%20")[1] == files.locate("file:/a/b c%20")[1] == files.locate("/a/b c%20")[1] == "/a/b c%20"


def test_strips_of_images_of_several_sizes(spark):
    import numpy as np

    from annograph.sources import images as I

    rng = np.random.default_rng(4)
    shapes = {"a": (8, 8, 3), "b": (5, 9, 1), "c": (8, 8, 3), "d": (1, 1, 4)}
    data = {p: rng.integers(0, 256, s, np.uint8) for p, s in shapes.items()}
    images = spark.createDataFrame([(p, *s, bytes(data[p].tobytes())) for p, s in shapes.items()], "path string, height int, width int, channels int, data binary")
    links = [(p, u, u + 1, *rng.uniform(-9, 20, 6).tolist()) for u in range(30) for p in shapes]
    strips = spark.createDataFrame(links, "path string, u int, v int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")
    found = {(r.path, r.u): r.patch for r in I.strip_pixels(images, strips, 7, 4).collect()}
    assert len(found) == len(links)
    mirror = lambda i, n: 0 if n == 1 else (n - 1) - abs((n - 1) - i % (2 * (n - 1)))
    for p, u, _, x0, y0, x1, y1, x2, y2 in links:
        h, w, c = shapes[p]
        wanted = np.zeros((c, 4, 7))
        for down in range(4):
            for across in range(7):
                x, y = (o + across / 6 * (a - o) + down / 3 * (b - o) for o, a, b in ((x0, x1, x2), (y0, y1, y2)))
                l, t = int(np.floor(x)), int(np.floor(y))
                at = lambda j, i: data[p][mirror(t + j, h), mirror(l + i, w)].astype(float)
                fx, fy = x - l, y - t
                wanted[:, down, across] = ((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy) / 255
        assert np.allclose(found[p, u], wanted.ravel(), atol=1e-6)
    I_sample = I.sample_strips(np.stack([data["a"], data["c"]]), np.array([links[0][3:], links[2][3:]]), 7, 4)
    assert I_sample.shape == (2, 4, 7, 3)
