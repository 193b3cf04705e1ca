"""Line, near-duplicate and byte-string deduplication against brute force, with odd inputs."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annograph.llm import graph, line_dedup, near_dedup, suffix_dedup
from annograph.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, row string, k1 int, id string, pos int, n_lines string, kept string, class_id string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "r", 1, "x", 2, "old", "old", "old") for i, t in docs], SCHEMA)


def rand_text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def odd_docs():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "ζeta", "12", "x"]
    shared = [rand_text(rng, words, 6) for _ in range(6)]
    docs = [(1, None), (2, ""), (3, "   \n\t\n"), (None, shared[0] + "\nnull id"), (4, "same line of twenty chars"), (4, "same line of twenty chars")]
    for i in range(10, 40):
        lines = [rng.choice([*shared, rand_text(rng, words, 5), "short", " \t" + shared[1].upper() + "\r"]) for _ in range(rng.randint(0, 9))]
        docs.append((i, "\n".join(lines)))
    docs.append((99, "\n".join([shared[2]] * 3000 + ["tail of the long text"])))
    return docs


def test_lines(spark):
    docs = odd_docs()
    got = line_dedup.dedup_lines(frame(spark, docs))
    assert got.columns == [*SCHEMA.replace(",", "").split()[::2], "n_dropped"]
    rows = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect())
    assert rows == sorted((i or 0, *x) for i, *x in brute.line_dedup(docs))


def test_lines_hot_key_is_spread(spark, monkeypatch):
    every = lambda c, k, w: [r[0] for r in c.select(F.xxhash64(*k)).collect()]
    monkeypatch.setattr("annograph.llm.line_dedup.heavy_keys", every)
    docs = odd_docs()
    rows = sorted((r["doc_id"] or 0, r["n_dropped"]) for r in line_dedup.dedup_lines(frame(spark, docs)).collect())
    assert rows == sorted((i or 0, d) for i, _, d, _ in brute.line_dedup(docs))


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("false")
    assert line_dedup.dedup_lines(none).count() == 0
    assert near_dedup.assign_classes(none).count() == 0
    assert near_dedup.keep_first(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def naive_similarity(a, b):
    wa, wb = ({k: 1 + np.log(n) for k, n in c.items()} for c in (a, b))
    both = set(wa) & set(wb)
    weighted = sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in set(wa) | set(wb)) for i in both)
    return max(weighted, len(both) / max(1, len(set(wa) | set(wb))))


def test_probability_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = ({int(k): float(w) for k, w in zip(rng.integers(0, 12, 8), rng.uniform(0.5, 3, 8))} for _ in range(2))
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        naive = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in set(a) | set(b)) for i in set(a) & set(b))
        assert near_dedup.probability_jaccard(*arrays) == pytest.approx(naive)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    keys = rng.integers(1, 2**63, 300).astype(np.uint64)
    sets = [(np.sort(keys[:200]), rng.uniform(1, 3, 200)), (np.sort(keys[80:280]), rng.uniform(1, 3, 200))]
    owner = np.repeat([0, 1], 200)
    made = near_dedup.signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), owner, 2, registers=4000)
    assert (made[0] == made[1]).mean() == pytest.approx(near_dedup.probability_jaccard(*sets), abs=0.04)


def test_every_pair_of_a_bucket_is_verified():
    """Pairs of similarity 0.8: what shares buckets comes out of exactly one of them."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(4000):
        common = rng.integers(1, 2**62, 84)
        texts += [np.r_[common, rng.integers(1, 2**62, 10)] for _ in range(2)]
    n = pa.array(range(len(texts)))
    words = pa.array([t.tolist() for t in texts], pa.list_(pa.int64()))
    batch = next(near_dedup._sign([pa.RecordBatch.from_arrays([n, n, n, words], names=["k1", "k2", "id", "words"])]))
    bands = {}
    for r in next(near_dedup._bands([batch])).to_pylist():
        bands.setdefault((r["bucket"], r["band"]), set()).add(r["node"])
    rows = {x: i for i, x in enumerate(batch.column("node").to_pylist())}
    made = [(k[1], sorted(rows[x] for x in v)) for k, v in bands.items() if len(v) == 2]
    marks = near_dedup._marks(batch.column("mark"))
    out = []
    for band, pair in made:
        own = tuple(m[pair] for m in marks) if isinstance(marks, tuple) else marks[pair]
        two = np.array([0, 1])
        out += [pair[0] for i, _ in near_dedup._compared(two * 0, two * 0 + band, two, two == two, own) for _ in i]
    assert sorted(out) == sorted({p[0] for _, p in made}) and len(out) > 3990


def test_links_by_plain_jaccard(spark):
    """Equal shingle sets of which one text repeats a half far more often: probability Jaccard is below 0.8."""
    docs = []
    for n in range(60):
        a, b = (" ".join(f"{x}{n}y{i}" for i in range(10)) + " " for x in "ab")
        docs += [(2 * n, a * 2 + b * 2), (2 * n + 1, a * 2 + b * 500)]
    sets = [near_dedup.shingles(np.array([hash(w) % 2**62 for w in t.split()], np.uint64)) for _, t in docs[:2]]
    assert near_dedup.probability_jaccard(*sets) < 0.75 and near_dedup.similarity(*sets) == 1
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.assign_classes(frame(spark, docs)).collect()}
    assert got == {i: i // 2 * 2 for i, _ in docs}


def copies():
    """Groups with chains: neighbours are similar, ends are not; a hub with many copies; exact copies; tiny texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (6, "one two three")]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(40):
        own = list(base)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            own[at] = rng.choice(words)
        docs.append((100 + i, " ".join(own)))
    chain = [rng.choice(words) for _ in range(100)]
    for i in range(12):
        chain = chain[4:] + [rng.choice(words) for _ in range(4)]
        docs.append((200 + i, " ".join(chain)))
    docs += [(300 + i, "a common text of copies " * 30) for i in range(20)]
    docs += [(400 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(20)]
    return docs


@pytest.mark.parametrize("block", [4000, 5])
def test_near_classes(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = copies()
    got = {r["doc_id"]: r for r in near_dedup.assign_classes(frame(spark, docs)).collect()}
    want = brute.near_classes(docs, lambda a, b: naive_similarity(a, b) >= 0.8)
    assert [got[i]["class_id"] for i, _ in docs] == want
    assert all(got[i]["class_size"] == want.count(c) and got[i]["kept"] == (i == c) for (i, _), c in zip(docs, want))


def test_near_classes_on_the_test_table(spark):
    docs = [(r[0], r[1]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.assign_classes(table(spark, SF, "documents")).collect()}
    plain = lambda a, b: len(a.keys() & b.keys()) >= 0.8 * len(a.keys() | b.keys())
    assert [got[i] for i, _ in docs] == brute.near_classes(docs, plain)


def test_keep_first_of_equal_rows(spark):
    docs = [(7, "equal text of the rows"), (7, "equal text of the rows"), (8, "equal text of the rows"), (9, None), (9, None), (None, "other words here")]
    got = near_dedup.keep_first(frame(spark, docs)).select("doc_id", "text").collect()
    assert sorted((r[0] or 0, r[1] or "") for r in got) == [(0, "other words here"), (7, "equal text of the rows"), (9, ""), (9, "")]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20] + [(100, 5), (100, 45), (7, 7)], "u int, v int")
    got = {r["node"]: r["label"] for r in graph.components(links).collect()}
    want = {n: 1 for n in [*range(1, 21), *range(41, 61), 100]} | {n: 21 for n in range(21, 41)}
    assert got == want
    assert graph.components(links.where("false")).count() == 0


def byte_docs():
    rng = random.Random(9)
    letters = "abcdefgh é"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [make(n) for n in (150, 199, 200, 203, 260, 420, 700)]
    docs = [(1, None), (2, ""), (3, "short"), (None, passages[5]), (4, passages[6]), (4, passages[6]), (5, "z" * 700), (6, "xy" * 300)]
    for i in range(10, 60):
        parts = [make(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            begin = rng.randint(0, 30)
            parts += [p[begin : len(p) - rng.randint(0, 30)], make(rng.randint(0, 120))]
        docs.append((i, "".join(parts)))
    return docs


@pytest.mark.parametrize("rows", [100_000, 3])
def test_repeats(spark, monkeypatch, rows):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", rows)
    docs = byte_docs()
    got = suffix_dedup.remove_repeats(frame(spark, docs)).collect()
    mine = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got)
    assert mine == sorted((i or 0, *x) for i, *x in brute.repeats(docs))


def test_segments_of_long_texts(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcd ") for _ in range(9000))
    powers = [suffix_dedup.Powers(b, 20_000) for b in suffix_dedup._BASES]
    whole = suffix_dedup._sampled(list(suffix_dedup._segments([text])), powers)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    parts = list(suffix_dedup._segments([text]))
    assert len(parts) == 9
    cut = suffix_dedup._sampled(parts, powers)
    assert all((a == b).all() for a, b in zip(whole[1:], cut[1:]))
