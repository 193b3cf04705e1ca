"""Registered queries against DuckDB, and the pipeline against brute force."""

import brute
import compare
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from annograph.llm import near_dedup, pieces, toxicity
from annograph.llm.common import table
from annograph.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    assert compare.compare(spark, compare.database("0.001"), name, QUERIES[name], ORACLES[name], "0.001") == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and not n.startswith("op12_")])
def test_rows(spark, name):
    source = "pages" if name.startswith("op8") else "documents"
    assert QUERIES[name](spark, SF).count() == table(spark, SF, source).count()


def test_pipeline(spark):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = table(spark, SF, "documents")
    model = toxicity.learn(docs, table(spark, SF, "labels"))
    matcher = toxicity.build_matcher(model.weights, model.exceptions)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clean = [r for r in rows if toxicity.score(model, matcher, r[1]) < 0.5]
    lined = [(i, text) for i, _, _, text in brute.line_dedup(clean)]
    classes = brute.near_classes(lined, lambda a, b: len(a.keys() & b.keys()) >= 0.8 * len(a.keys() | b.keys()))
    single = [r for r, c in zip(lined, classes) if r[0] == c]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    bad = {x[0] for x in brute.contamination(single, items) if x[4]}
    kept = {i: text for i, text in single if i not in bad}
    assert {i: r["text"] for i, r in got.items()} == kept
    vocab = pieces.vocabulary(pieces.MODEL)
    assert all(pieces.decode_ids(_array(r["ids"]), vocab) == r["text"] for r in got.values())


def _array(ids):
    import numpy as np

    return np.array(ids, np.int64)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_documents(spark, name, stage):
    rows = [(1, None, None, "a", None, "old"), (2, "", "en", None, 0, "old"), (3, "twice the same words", "en", "a", 3, "old"), (3, "twice the same words", "en", "a", 3, "old"), (None, "no id " * 30_000, "xx", "b", 1, "old")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string")
    out = stage(spark, docs, SF)
    assert out.columns[:6] == docs.columns
    assert {r[0] for r in out.select("doc_id").collect()} == {1, 2, 3, None}
    assert stage(spark, docs.where("false"), SF).where(F.lit(True)).count() == 0


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    assert near_dedup.SHINGLE == 5 and near_dedup.SIMILARITY == 0.8
