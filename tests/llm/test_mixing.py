"""Mixing sources to target weights against a plain restatement."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from annograph.llm import common, mix

SCHEMA = "doc_id bigint, source string, text string, target string, row string, epochs int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, docs):
    return spark.createDataFrame([(i, s, t, "old", "r", 7) for i, s, t in docs], SCHEMA)


def shares(sizes, weights=(1, 2, 3), most=3):
    """Targets by handing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        level = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if level[s] > most * sizes[s]}
        if not above:
            return {s: level.get(s, most * sizes[s]) for s in names}
        full |= above


def mixed(docs):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    out, target = [], shares(sizes)
    for s, budget in target.items():
        whole = round(budget)
        rounds = whole // sizes[s] if sizes[s] else 0
        left = whole - rounds * sizes[s]
        rows = sorted(((i, t) for i, x, t in docs if x == s), key=lambda r: (hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), size(r[1])))
        for i, t in rows:
            more = min(left, size(t))
            out.append((i, size(t), sizes[s], budget, rounds * size(t) + more))
            left -= more
    return out


def made(seed):
    rng = random.Random(seed)
    sources = ["big", "a", "b", "Ä", "é", "😀", "", None, "tiny", "none"]
    docs = [(None, "a", "no id"), (None, "a", "no id"), (5, "b", None), (6, "none", " \t\n"), (7, "tiny", "one"), (8, "", "x y")]
    for i in range(10, 150):
        s = "big" if rng.random() < 0.5 else rng.choice(sources[:-2])
        docs.append((i, s, rng.choice([" ", "\n", ""]).join(["wörd"] * rng.randint(0, 30)) + rng.choice(["", " \r\n", "\x0b end"])))
    docs.append((999, "big", "long " * 20_000))
    return docs + docs[10:14]


def result(df):
    return sorted(((r["doc_id"] or 0, r["size"], r["source_size"], r["target"], r["taken"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain_rule(spark, seed):
    docs = made(seed)
    got = mix.mix_sources(mix.with_sizes(frame(spark, docs)))
    assert got.columns == ["doc_id", "source", "text", "row", "size", "source_size", "target", "epochs", "part", "taken"]
    want = sorted(((i or 0, *x) for i, *x in mixed(docs)), key=repr)
    mine = result(got)
    assert [r[:3] + r[4:] for r in mine] == [r[:3] + r[4:] for r in want]
    assert all(a[3] == pytest.approx(b[3], rel=1e-12) for a, b in zip(mine, want))
    assert all(r[4] <= 3 * r[1] for r in mine)
    by_source = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("b")).collect()
    assert all(abs(r["t"] - r["b"]) <= 0.5 for r in by_source)


def test_runs_agree_whatever_the_partitions(spark, monkeypatch):
    docs = made(4)
    one = result(mix.mix_sources(mix.with_sizes(frame(spark, docs))))
    monkeypatch.setattr(common, "RANGE_ROWS", 7)
    assert result(mix.mix_sources(mix.with_sizes(frame(spark, docs[::-1]).repartition(9)))) == one


def test_a_third_of_the_rows_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(common, "RANGE_ROWS", 20)
    docs = [(None, "a", "five words in every one")] * 300 + [(i, "b", "x " * i) for i in range(1, 60)]
    assert result(mix.mix_sources(mix.with_sizes(frame(spark, docs)))) == sorted(((i or 0, *x) for i, *x in mixed(docs)), key=repr)


def test_empty_and_wordless(spark):
    none = frame(spark, [(1, "a", "x")]).where("false")
    assert mix.mix_sources(mix.with_sizes(none)).count() == 0
    rows = mix.mix_sources(mix.with_sizes(frame(spark, [(1, "a", ""), (2, None, None)]))).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_copies(spark):
    docs = made(6)
    got = mix.mix_sources(mix.with_sizes(frame(spark, docs)))
    rows = mix.copies(got).collect()
    assert sum(len(WORD.findall(r["text"])) for r in rows) == got.agg(F.sum("taken")).first()[0]
    texts = {t for _, _, t in docs}
    cut = [r for r in rows if r["copy"] > r["epochs"]]
    assert cut and all(any((t or "").startswith(r["text"]) for t in texts) for r in cut)
    assert all(r["text"] in texts for r in rows if r["copy"] <= r["epochs"])


def test_weights(spark):
    docs = [(i, s, "w " * 10) for i in range(40) for s in "abcd"]
    got = mix.mix_sources(mix.with_sizes(frame(spark, docs)), weights=(5, 1))
    shares_ = {r["source"]: r["t"] for r in got.groupBy("source").agg(F.first("target").alias("t")).collect()}
    assert shares_ == pytest.approx({"a": 1600 * 5 / 12, "b": 1600 / 12, "c": 1600 * 5 / 12, "d": 1600 / 12})
