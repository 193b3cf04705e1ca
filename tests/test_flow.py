"""The chained steps over folders, with ordinary and large documents."""

import json

import numpy as np

from annograph.operators import normalize as N
from annograph.plans import flow
from annograph.sources.pixels import png_bytes


def folders(tmp_path):
    pictures, notes = tmp_path / "img", tmp_path / "ann"
    pictures.mkdir()
    notes.mkdir()
    blank = png_bytes(np.zeros((256, 256, 3), np.uint8))
    for name in ("good", "empty", "lonely", "dup", "broken", "big"):
        (pictures / f"{name}.png").write_bytes(blank)
    (pictures / "bad.png").write_bytes(b"nothing")
    two = {"points": [{"id": 0, "x": 1, "y": 2}, {"id": 1, "x": 3, "y": 4}], "edges": [{"src": 0, "dst": 1}]}
    texts = {
        "good": json.dumps(two), "empty": '{"points":[]}', "dup": json.dumps({**two, "edges": two["edges"] * 2}), "broken": "{", "bad": json.dumps(two),
        "orphan": json.dumps(two),
        "big": json.dumps({"points": [{"id": i, "x": i % 256, "y": 0} for i in range(6)], "edges": [{"src": 0, "dst": i} for i in range(1, 6)]}),
    }
    for name, text in texts.items():
        (notes / f"{name}.json").write_text(text)
    return str(pictures), str(notes)


def check(spark, tmp_path):
    tables = flow.run_flow(spark, *folders(tmp_path), str(tmp_path / "out"))
    s = tables["summary"].first()
    assert (s.num_images, s.num_annotations, s.paired_samples, s.missing_annotations, s.orphan_annotations) == (7, 7, 6, 1, 1)
    assert (s.samples_with_errors, s.invalid_json, s.invalid_image, s.degree_overflow_samples, s.samples_with_warnings) == (3, 1, 1, 1, 1)
    assert (s.zero_point_samples, s.one_point_samples, s.zero_edge_samples) == (3, 0, 3)
    assert tables["points"].first().images_exported == 2 and tables["edges"].first().samples_routed_to_error == 5
    written = {r.json_dst.rsplit("/", 1)[1]: json.loads(r.body) for r in spark.read.parquet(str(tmp_path / "out" / "*" / "edges_tables" / "documents")).collect()}
    assert set(written) == {"good.json", "big.json"} and [e["dst"] for e in written["big.json"]["edges"]] == [1, 2, 3, 4, 5]
    assert [p["id"] for p in written["big.json"]["points"]] == list(range(6)) and written["good.json"]["image_path"] == "good.png"
    lines = {r.line for r in tables["digest"].collect()}
    assert "[lonely] missing_annotation" in lines and "[broken] error, zero_point, zero_edge" in lines
    assert "  warning: 1 个点的度数超过 2: [0]" in lines and "  error: edge[1] 与已有边重复，已去重" in lines


def test_flow(spark, tmp_path):
    check(spark, tmp_path)


def test_flow_with_large_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N.normalize_rows, "__defaults__", ("messages", 4))
    check(spark, tmp_path)
