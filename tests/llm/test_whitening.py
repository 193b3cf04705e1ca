"""Whitening against exact arithmetic on small tables."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from annograph.llm import whiten
from annograph.llm.common import table
from annograph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "c") for i, v in rows], SCHEMA)


def exact(rows):
    """(kept rows as whole numbers, n, S, covariance as fractions)"""
    kept = [(i, [floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and isfinite(c) for c in v)]
    fit = list({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    v = [[Fraction(n * sum(x[i] * x[j] for x in fit) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    return kept, n, s, v


def check(rows, got, components):
    kept, n, s, v = exact(rows)
    v = np.array(v, float)
    e = np.sort(np.linalg.eigvalsh(v))[::-1][:components]
    by_row = {}
    for r in got:
        assert r["n"] == n
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    want = {}
    for i, x in kept:
        want.setdefault((i, sum((n * a - b) ** 2 for a, b in zip(x, s))), []).append(x)
    assert {k: len(r) for k, r in by_row.items()} == {k: len(x) * len(e) for k, x in want.items()}
    assert {r["component"] for r in got} == set(range(1, len(e) + 1))
    first = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(1, len(e) + 1):
        assert first[kept[0][0], k]["explained"] == pytest.approx(e[k - 1] / np.trace(v), rel=1e-9)
    fit = {tuple(x): i for i, x in kept}
    w = np.array([[first[i, k]["whitened"] for k in range(1, len(e) + 1)] for i in fit.values()])
    assert np.abs(w.T @ w / n - np.outer(w.mean(0), w.mean(0)) - np.eye(len(e))).max() < 1e-9
    axes = np.linalg.lstsq(np.array([list(x) for x in fit], float) - np.array(s) / n, w * np.sqrt(e), rcond=None)[0]
    assert np.abs(v @ axes - axes * e).max() < 1e-7 * e[0]
    assert all(abs(r["identity_error"]) < 1e-9 for r in got) and len({r["identity_error"] for r in got}) == 1


def made(seed, n=90, d=20):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    return [*rows, rows[0], (500, rows[1][1]), (501, None), (502, [None] * d), (503, [float("nan")] * d), (504, [float("inf")] + [0.0] * (d - 1)), (None, [1.0] * d)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_fractions(spark, seed):
    rows = made(seed)
    check(rows, whiten.whiten(frame(spark, rows)).collect(), 16)


def test_wide_ranges(spark):
    rows = [(i, [c * 10.0 ** (k % 7) for k, c in enumerate(v)]) for i, v in made(3, 60, 5)[:60]]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    check(rows, whiten.whiten(frame(spark, rows)).collect(), 5)


def test_blocks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(whiten, "BLOCK_BITS", 1)
    rows = made(4, 300, 6)
    check(rows, whiten.whiten(frame(spark, rows).repartition(5)).collect(), 6)


def test_bit_planes_count_products():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2**33, (200, 4))
    bits = [33, 33, 34, 40]
    dims, shifts = np.repeat(np.arange(4), bits), np.concatenate([np.arange(b) for b in bits])
    counts = np.zeros((4, 4, 79), np.int64)
    whiten.scatter(whiten.bit_planes(y, bits), dims, shifts, counts)
    for i in range(4):
        for j in range(i, 4):
            assert sum(int(c) << s for s, c in enumerate(counts[i, j])) == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j]))


def test_huge_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])]
    got = whiten.whiten(frame(spark, rows)).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: None, 2: None, 3: 446464}
    assert got[0]["identity_error"] < 1e-4


def test_no_variance_and_no_rows(spark):
    assert whiten.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten.whiten(frame(spark, [(1, [])])).count() == 0
    empty = whiten.whiten(frame(spark, [(1, [1.0])]).where("false"))
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = whiten.whiten(frame(spark, [(1, [1.0, 2.0, 7.0]), (2, [1.0, 3.0, 7.0]), (3, [1.0, 9.0])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in flat) == [(1, 1), (2, 1)]


def test_fitted_model_serves_new_rows(spark):
    rows = made(6)
    model = whiten.fit_model(whiten.usable_vectors(frame(spark, rows)))
    new = whiten.whiten(frame(spark, rows[:3]), model=model)
    old = whiten.whiten(frame(spark, rows))
    key = lambda df: {(r["vec_id"], r["component"]): r["whitened"] for r in df.where("vec_id < 3").collect()}
    assert key(new) == pytest.approx(key(old), rel=1e-9, abs=1e-9)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    got = QUERIES["op12_whiten"](spark, SF).collect()
    assert len(got) == 16 * len(rows)
    check(rows, got, 16)
