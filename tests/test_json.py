"""Annotation texts of any size and with any numbers, against Python's json module."""

import json
import random

import pytest
from pyspark.sql import functions as F

from annograph.functions import json_text as J
from annograph.sources import annotations as S

SCHEMA = "path string, stem string, raw string"
TEXTS = {
    "nan": '{"points":[{"id":0,"x":NaN,"y":-Infinity,"score":Infinity}],"metadata":{"a":NaN}}', "behind": '{"points":[]} x', "two": '{"points":[]},{"b":2}', "closed": '{"points":[]}] x',
    "sentinel": '{"points":[]}, "annograph: end of document"] x', "single": "{'points':[]}", "list": "[1, 2]", "empty": "", "blank": " \n", "null": "null", "word": "nul", "mark": '﻿{"points":[]}',
    "plain": ' {"points" : [ {"x":1,"y":2}, 7 ] , "edges":[{"src":0,"dst":0}]}\r\n', "twice": '{"points":[1],"points":[{"x":3,"y":4}]}', "control": '{"points":"x\ty"}', "cut": '{"points":[{"x":1',
    "comma": '{"points":[1,]}', "colon": '{"points" []}', "key": '{5:[]}', "nested": '{"a":{"points":[1,2]},"points":[{"x":[1,{"y":2}],"y":"]"}]}', "escaped": '{"po\\u0069nts":[{"x":1,"y":2}],"image_path":"a\\"]b"}',
    "shapes": '{"shapes":[{"label":"sew","shape_type":"point","points":[[1,2]]},{"label":"sew","shape_type":"point","points":[[3,4]],"score":0.5}],"imagePath":"z.png"}',
}


def rows(spark, texts):
    return spark.createDataFrame([(f"p/{n}.json", n, t) for n, t in texts.items()], SCHEMA)


def loaded(text):
    try:
        return json.loads(text)
    except ValueError:
        return ValueError


def points_of(parsed):
    return {r.sample_id: None if not r.readable else [(p.pos, p.is_object, p.id, str(p.x), str(p.y), str(p.score)) for p in r.raw_points] for r in parsed.collect()}


def test_same_texts_are_readable(spark):
    got = {r.sample_id: (r.readable, r.is_object) for r in S.parse_annotations(rows(spark, TEXTS)).collect()}
    assert got == {n: ((v := loaded(t)) is not ValueError, isinstance(v, dict)) for n, t in TEXTS.items()}


@pytest.mark.parametrize("reader", [S.parse_annotations, S.to_point_schema, S.review_documents])
def test_parts_give_what_the_whole_gives(spark, monkeypatch, reader):
    """With every VARIANT refused, all documents come in parts of two elements."""
    texts = {n: t for n, t in TEXTS.items() if loaded(t) is ValueError or isinstance(loaded(t), dict)}
    plain = lambda df: sorted(map(str, (r.asDict(True) for r in df.select(*[F.to_json(c).alias(c) if c in ("roi", "segments", "metadata") else F.col(c) for c in df.columns]).collect())))
    whole = plain(reader(rows(spark, texts)))
    document = J.document
    heads = lambda raw: document(raw) if "head" in str(raw) else F.lit(None).cast("variant")
    monkeypatch.setattr(J, "document", heads)
    monkeypatch.setattr(J, "SPLIT_BYTES", -1)
    assert plain(reader(rows(spark, texts))) == whole


def test_split_cuts_between_elements(monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 3)
    rng = random.Random(4)
    for _ in range(200):
        value = lambda: rng.choice([1, None, "a,]}\"\\", [1, [2]], {"points": [1, 2]}, -0.5e3, True, "", {}])
        doc = {k: [value() for _ in range(rng.randint(0, 8))] if rng.random() < 0.6 else value() for k in rng.sample(["points", "edges", "shapes", "x", "roi"], rng.randint(0, 5))}
        text = json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        parts = J.split(f" \n{text}\t")
        arrays = {n: parts[n] for n in J.LONG_ARRAYS if parts[n] is not None}
        assert all(len(json.loads(c)) <= 3 for chunks in arrays.values() for c in chunks)
        assert {**json.loads(parts["head"]), **{n: [x for c in chunks for x in json.loads(c)] for n, chunks in arrays.items()}} == doc
        broken = text[: rng.randrange(len(text))] + rng.choice(["", "}", "]", ",", "x"])
        assert J.split(broken) is None or isinstance(json.loads(broken), dict)


def test_long_string(spark):
    text = '{"points":[{"x":1,"y":2}],"metadata":{"note":"' + "x" * 21_000_000 + '"}}'
    row = S.parse_annotations(rows(spark, {"s": text})).select("readable", F.size("raw_points").alias("n"), F.length(F.to_json("metadata")).alias("m")).first()
    assert tuple(row) == (True, 1, 21_000_011)


def test_text_beyond_one_variant(spark, tmp_path):
    """150 MB of text; its VARIANT would exceed Spark's limit."""
    n = 2_600_000
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"image_path":"a.png","points":[')
        f.writelines(f'{"," if i else ""}{{"id":{i},"x":{i % 977}.5,"y":{i % 555},"source":"by hand, twice"}}' for i in range(n))
        f.write('],"edges":[{"src":0,"dst":1},5]}')
    assert (tmp_path / "big.json").stat().st_size > 150e6
    raw = S.read_annotations(spark, str(tmp_path))
    p = F.col("raw_points")
    row = S.parse_annotations(raw).select("readable", "image_path", F.size(p).alias("n"), p[n - 1]["id"].alias("id"), p[n - 1]["x"].alias("x"), F.size("raw_edges").alias("m")).first()
    assert tuple(row) == (True, "a.png", n, n - 1, (n - 1) % 977 + 0.5, 2)
