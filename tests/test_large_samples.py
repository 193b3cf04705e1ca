"""Registered queries with a tiny document limit, so that most samples take the table form."""

import compare
import pytest

from annograph.catalog import ORACLES, QUERIES
from annograph.operators import normalize as N

NAMES = ("a1_validation_summary", "p13_json_round_trip", "k1_written_documents", "j15_merge_annotations", "j16_load_precedence", "e5_review_stamp")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, monkeypatch, name):
    monkeypatch.setattr(N.split_by_size, "__defaults__", (3,))
    assert compare.compare(spark, compare.database("0.001"), name, QUERIES[name], ORACLES[name], "0.001") == ""


@pytest.mark.parametrize("name", ["k1_written_documents", "k3_edge_documents"])
def test_exports_normalise_the_corpus_once(spark, monkeypatch, name):
    calls, plain = [], N.normalize_documents
    monkeypatch.setattr(N, "normalize_documents", lambda *args, **kwargs: calls.append(args) or plain(*args, **kwargs))
    assert compare.compare(spark, compare.database("0.001"), name, QUERIES[name], ORACLES[name], "0.001") == ""
    assert len(calls) == 1
