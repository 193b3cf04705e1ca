"""Selection, merging and neighbour search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annograph.operators import graph as G, predict as P


def spans(kept, a, b):
    """Number of kept links on the shortest way from a to b, by distance labels over all nodes."""
    far = {a: 0}
    for _ in range(len(kept)):
        for u, v in kept:
            for x, y in ((u, v), (v, u)):
                if x in far and far[x] + 1 < far.get(y, math.inf):
                    far[y] = far[x] + 1
    return far.get(b, math.inf)


def worth(link, kept, xy, weight):
    """Score plus, at each end with one kept neighbour, the share of a straight angle there."""
    _, a, b, score = link
    for here, there in ((a, b), (b, a)):
        mates = {v for u, v in kept if u == here} | {u for u, v in kept if v == here}
        if len(mates) == 1:
            arms = [np.array(xy[n]) - xy[here] for n in (*mates, there)]
            sizes = [np.sqrt(arm @ arm) for arm in arms]
            if min(sizes) >= 1e-6:
                score += weight * (1 - np.clip(arms[0] @ arms[1] / (sizes[0] * sizes[1]), -1, 1)) / 2
    return score


def check_picks(rows, picks, xy, p):
    """Each pick is the first of the best links that the earlier picks leave admissible, and none is left at the end."""
    kept, taken = [], set()
    for pick in [*picks, None]:
        ends = [n for link in kept for n in link]
        admissible = [
            r for r in rows
            if r[0] not in taken and ends.count(r[1]) < p["max_degree"] and ends.count(r[2]) < p["max_degree"]
            and not (p["max_small_cycle_length"] >= 3 and spans(kept, r[1], r[2]) < p["max_small_cycle_length"])
        ]
        if pick is None:
            assert not admissible
            return
        values = {r[0]: worth(r, kept, xy, p["continuity_weight"]) for r in admissible}
        best = max(values.values())
        assert values[pick] == pytest.approx(best, abs=1e-12)
        assert not [r for r in admissible if r[0] < pick and values[r[0]] == best and values[pick] == best]
        taken.add(pick)
        kept.append(rows[pick][1:3])


def link_rows(seed, samples, nodes, step):
    """Random links; with a `step`, scores and places are tied often."""
    rng = random.Random(seed)
    links, points, expected = [], [], {}
    for s in range(samples):
        n = rng.randint(3, nodes)
        xy = {i: (float(rng.randint(0, 60)), float(rng.randint(0, 60))) for i in range(n)}
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.3 if s % 2 else 0.6)]
        rows = [(k, a, b, 1 - step * rng.randint(0, 8) if step else rng.random()) for k, (a, b) in enumerate(pairs)]
        links += [(s, *r) for r in rows]
        points += [(s, i, *xy[i]) for i in xy]
        expected[s] = (rows, xy)
    return links, points, expected


@pytest.mark.parametrize("limit", [50_000, 0])
@pytest.mark.parametrize("step", [0, 0.01])
def test_selection(spark, limit, step):
    links, points, expected = link_rows(limit + 7, 60, 12, step)
    df = spark.createDataFrame(links, "sample_id long, pos int, src int, dst int, score double")
    xy = spark.createDataFrame(points, "sample_id long, id int, x double, y double")
    for preset in ("conservative", "balanced", "aggressive"):
        p = P.resolve_preset(preset)
        got = {}
        for r in P.select_links(df, xy, preset, limit=limit).orderBy("sample_id", "edge_id").collect():
            got.setdefault(r.sample_id, []).append((r.src, r.dst))
        for s, (rows, spots) in expected.items():
            _, src, dst, score = ([r[k] for r in rows] for k in range(4))
            picks = [i for i, _, _ in P.pick_links(src, dst, score, spots, p["max_degree"], p["max_small_cycle_length"], p["continuity_weight"])]
            check_picks(rows, picks, spots, p)
            assert got.get(s, []) == [rows[i][1:3] for i in sorted(picks, key=lambda i: -score[i])], (preset, s)


def test_numbering_of_equal_scores():
    """A link that a bonus lifts is numbered when it is picked, not where it stands in the list."""
    xy = {0: (32, 130), 1: (60, 253), 2: (230, 241), 3: (194, 107)}
    p = P.resolve_preset("balanced")
    picks = P.pick_links([0, 0, 1, 1, 2], [1, 3, 2, 3, 3], [1, 1, 1, 0.92, 1], xy, p["max_degree"], p["max_small_cycle_length"], p["continuity_weight"])
    assert [i for i, _, _ in picks] == [0, 2, 1]


def test_degree_limit_zero_and_unknown_preset(spark):
    df = spark.createDataFrame([(1, 0, 0, 1, 0.9)], "sample_id long, pos int, src int, dst int, score double")
    assert P.select_links(df, None, max_degree=0).count() == 0
    try:
        P.resolve_preset("none")
    except ValueError:
        return
    raise AssertionError("unknown preset accepted")


def complete_linkage(points, reach):
    """Merge the closest pair of groups (largest member distance) while it is within reach."""
    groups = [[i] for i in range(len(points))]
    gap = lambda a, b: max(math.dist(points[i], points[j]) for i in a for j in b)
    while len(groups) > 1:
        d, i, j = min((gap(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d > reach:
            break
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


def test_merge_equals_complete_linkage(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for image in range(25):
        spots = [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(rng.randint(1, 30))]
        scores = [rng.random() for _ in spots]
        rows += [(image, i, x, y, s) for i, ((x, y), s) in enumerate(zip(spots, scores))]
        expected[image] = sorted(max(g, key=lambda i: scores[i]) for g in complete_linkage(spots, 15.0))
    df = spark.createDataFrame(rows, "image_id long, idx int, x double, y double, score double")
    for limit in (512, 0):
        got = {}
        for r in P.merge_near_points(df, 15.0, limit).collect():
            got.setdefault(r.image_id, []).append(r.idx)
        assert {k: sorted(v) for k, v in got.items()} == expected


def test_merge_forms_agree_with_ties_and_equal_spots(spark):
    rng = random.Random(8)
    rows = [(im, i, float(rng.randint(0, 25)), float(rng.randint(0, 25)), rng.random()) for im in range(10) for i in range(40)]
    df = spark.createDataFrame(rows, "image_id long, idx int, x double, y double, score double")
    a, b = (sorted((r.image_id, r.idx) for r in P.merge_near_points(df, 6.0, limit).collect()) for limit in (512, 0))
    assert len(a) == len(b) > 20


def test_merge_windows_equal_joins_and_write_one_table_a_round(spark, monkeypatch):
    """Images that a window holds never take the joins; both forms give the same rows, also of ties, equal spots and long chains."""
    rng = random.Random(12)
    rows = [(im, i, float(rng.randint(0, 25)), float(rng.randint(0, 25)), rng.random()) for im in range(3) for i in range(25)]
    rows += [(50, i, i * 1.5 + i * i * 0.01, 0.0, 0.5) for i in range(12)] + [(51, 0, 1.0, 1.0, 0.5), (None, 0, 1.0, 1.0, 0.5), (52, 0, None, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "image_id long, idx int, x double, y double, score double")
    got, tables = {}, {}
    for window in (2048, 0):
        with monkeypatch.context() as m:
            m.setattr(P, "MERGE_WINDOW", window)
            written, plain = [], P.materialize
            m.setattr(P, "materialize", lambda df, label="stage": written.append(label) or plain(df, label))
            got[window] = sorted(map(tuple, P.merge_near_points(df, 6.0, limit=0).collect()))
            tables[window] = len(written)
    assert got[2048] == got[0]
    assert tables[2048] < tables[0] / 2


def test_large_features_equal_small_ones(spark):
    rng = random.Random(6)
    rows = [(s, i, rng.uniform(0, 200), rng.uniform(0, 200), rng.random()) for s in range(4) for i in range(40)]
    points = spark.createDataFrame(rows, "sample_id long, id int, x double, y double, score double")
    edges = spark.createDataFrame([(s, i, i + 1) for s in range(4) for i in range(0, 38, 3)], "sample_id long, src int, dst int")
    small, large = G.graph_features(points, edges), G.graph_features(points, edges, limit=10)
    flat = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.collect())
    for a, b in zip(small, large):
        assert flat(a.select(sorted(a.columns))) == flat(b.select(sorted(a.columns)))


def test_spacing_ignores_an_outlier_and_defaults(spark):
    spots = [(0, i, 10.0 * i, 0.0) for i in range(10)] + [(0, 10, 900.0, 0.0), (1, 0, 5.0, 5.0)]
    points = spark.createDataFrame(spots, "sample_id long, id int, x double, y double")
    for limit in (64, 5):
        assert {r.sample_id: r.spacing for r in G.spacing(points, limit=limit).collect()} == {0: 10.0, 1: 28.0}


def test_split_sizes(spark):
    samples = spark.range(101).withColumnRenamed("id", "sample_id")
    first = {r.sample_id: r.part for r in G.split_samples(samples).collect()}
    assert sum(p == "val" for p in first.values()) == 20
    assert first == {r.sample_id: r.part for r in G.split_samples(samples.repartition(7)).collect()}
    assert [r.part for r in G.split_samples(samples.limit(1)).collect()] == ["both"]
    assert G.split_samples(samples, 0.15, kind="points").where(F.col("part") == "val").count() == 15


def test_chain_when_there_are_no_neighbours(spark):
    points = spark.createDataFrame([(0, i, 100.0 * i, 0.0, 1.0) for i in range(3)], "sample_id long, id int, x double, y double, score double")
    _, edges = G.graph_features(points, k=0, radius_multiplier=0.1)
    assert sorted((r.u, r.v) for r in edges.collect()) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("step", [0, 0.01])
@pytest.mark.parametrize("rules", [(2, 5, 0.3), (2, 3, 0.1), (3, 4, 0.2), (1, 4, 0.2), (2, 0, 0.0)])
def test_groups_at_once_equal_groups_one_by_one(step, rules):
    links, points, expected = link_rows(5, 300, 14, step)
    sample, _, src, dst, score = (np.array(c) for c in zip(*links))
    names, group = np.unique(sample, return_inverse=True)
    own, ids, x, y = (np.array(c) for c in zip(*[p for p in points if p[1] != 2 and p[0] in expected and p[0] in names]))
    own = np.searchsorted(names, own)
    for spots in (None, (own, ids, x, y)):
        done, (row, floor, low, turn) = P.pick_arrays.pick(group, src, dst, score, spots, *rules)
        assert done.all()
        for g in range(len(names)):
            at = np.flatnonzero(group == g)
            xy = None if spots is None else {i: (a, b) for o, i, a, b in zip(own, ids, x, y) if o == g}
            wanted = [(at[i], f, at[k]) for i, f, k in P.pick_links(src[at].tolist(), dst[at].tolist(), score[at].tolist(), xy, *rules)]
            mine = np.flatnonzero(group[row.astype(int)] == g)
            mine = mine[np.argsort(turn[mine])]
            assert [(row[m], floor[m], low[m]) for m in mine] == wanted


def test_odd_groups_are_picked_too(spark):
    odd = [(400, 0, 3, 3, 0.5), (400, 1, 3, 4, 0.4), (403, 0, 1, 2, 0.9), (403, 1, 2, 3, 0.7), (None, 0, 1, 2, 0.9), (None, 1, 2, 5, 0.8)]
    df = spark.createDataFrame(odd, "sample_id long, pos int, src int, dst int, score double")
    xy = spark.createDataFrame([(None, 1, 0.0, 0.0), (402, 0, 1.0, 1.0), (403, 2, float("nan"), 0.0)], "sample_id long, id int, x double, y double")
    for spots in (None, xy):
        found = [(r.sample_id, r.src, r.dst) for r in P.select_links(df, spots).collect()]
        assert sorted(map(str, found)) == sorted(map(str, [(s, a, b) for s, _, a, b, _ in odd if (a, b) != (3, 3)]))


def test_small_groups_are_picked_together():
    links, _, _ = link_rows(3, 100, 9, 0)
    sample, _, src, dst, score = (np.array(c) for c in zip(*links))
    _, group = np.unique(sample, return_inverse=True)
    done, _ = P.pick_arrays.pick(group, src, dst, score, None, 2, 4, 0.2)
    assert done.all()


def test_samples_measured_at_once_equal_the_column_form(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(s, i, float(rng.randint(0, 30)), rng.uniform(0, 30), rng.random()) for s in range(80) for i in range(rng.randint(1, 20))]
    rows += [(90, i, 1.0, float("nan") if i == 2 else float(i), 1.0) for i in range(5)] + [(91, 3, 0.0, 0.0, 1.0), (91, 3, 4.0, 3.0, 1.0), (91, 5, 4.0, 0.0, None), (None, 0, 1.0, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "sample_id long, id int, x double, y double, score double")
    flat = lambda: sorted(str(r) for r in G.sample_rows(points, 2.5, 8).collect())
    found = flat()
    calls = []

    def by_columns(function, kind):
        calls.append(function)
        return lambda column: F.lit(None).cast(kind)

    monkeypatch.setattr(G.F, "arrow_udf", by_columns)
    assert found == flat() and len(calls) == 1


def test_connected_groups_of_windows_equal_those_of_joins(spark, monkeypatch):
    """Short and long groups, repeated links, loops and nulls; small samples settle without a join."""
    rng = random.Random(5)
    short = [(s, rng.randint(0, 20), rng.randint(0, 20)) for s in range(30) for _ in range(rng.randint(1, 15))]
    chain = [(99, n, n + 1) for n in range(60)]
    shape = "sample_id int, src int, dst int"
    df = spark.createDataFrame([*short, *chain, (None, 1, 2), (98, 3, None)], shape)
    listed = lambda out: sorted(tuple(r) for r in out.select("sample_id", "node", "component").collect())
    expected = listed(P._groups_by_joins(df.dropna()))
    assert listed(P.connected_groups(df)) == listed(P.connected_groups(df, limit=10)) == expected
    assert {c for s, _, c in expected if s == 99} == {0}
    written = []
    kept = P.materialize
    monkeypatch.setattr(P, "materialize", lambda t, label: written.append(t._jdf.queryExecution().optimizedPlan().toString()) or kept(t, label))
    pairs = spark.createDataFrame([(s, 0, 1) for s in range(40)], shape)
    assert len(listed(P.connected_groups(pairs))) == 80
    assert len(written) == 1 and "Join" not in written[0]
