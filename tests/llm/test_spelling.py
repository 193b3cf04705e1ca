"""Spelling variants against plain restatements."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from annograph.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n string, form string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "old", "old", "old") for i, t in docs], SCHEMA)


def words_of(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def grouped(words):
    around = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            around[a].append(b)
            around[b].append(a)
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(around[w]), words[form[w]] if form[w] else None))
    return out


def rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed):
    rng = random.Random(seed)
    alphabet = "abÀÿéz"
    words = ["".join(rng.choice(alphabet[: rng.randint(2, 6)]) for _ in range(rng.randint(4, 9))) for _ in range(40)]
    for w in [rng.choice(words) for _ in range(200)]:  # slips of earlier words
        at = rng.randrange(len(w))
        words.append(w[:at] + rng.choice(["", rng.choice(alphabet), rng.choice(alphabet) + w[at]]) + w[at + 1 :])
    words += ["a" * k for k in range(4, 40)] + ["x" * 300, "x" * 299 + "y", "x" * 301, "y" + "x" * 299]
    docs = [(None, None), (None, " ".join(words[:30] * 4)), (2, ""), (3, "123 – 😀 … ab cd"), (4, "ßßßßß ×÷×÷× Ωabcde日本abcde abcde"), (5, "kette " * 40 + "ketten " * 16 + "kettena " * 7 + "kettenab " * 3)]
    for i in range(10, 60):
        picked = rng.choices(words, [1 / (1 + k) ** 0.7 for k in range(len(words))], k=rng.randint(1, 150))
        docs.append((i, rng.choice([" ", "\n", "1", "–"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in picked)))
    return docs + docs[5:8]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain_rule(spark, seed):
    docs = made(seed)
    want = grouped(words_of(docs))
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)
    assert rows(spelling.variants(frame(spark, docs))) == want


@pytest.mark.parametrize("limit", [1, 100, 1000])
def test_long_lists_are_split(spark, limit):
    words = {w: n for w, n in words_of(made(5)).items()}
    words |= {"prefix" + a + b + c + "suffix": 3 + len(a) for a in ["", "a", "b"] for b in "abcdé" for c in "abcxyzÿ"}
    vocab = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert rows(spelling.group_variants(vocab, limit=limit)) == grouped(words)


def test_scan_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SCAN_ROWS", 5)
    monkeypatch.setattr(spelling, "SCAN_CELLS", 100)
    monkeypatch.setattr(spelling, "PIECE", 7)
    monkeypatch.setattr(spelling, "COUNTED", 3)
    docs = made(6)
    assert sum(len(x) for x, _ in spelling.scan([sorted({"abcde", "abcdf", "abcdef", "xbcde", "abde1"})])) == 6
    vocab = spark.createDataFrame(list(words_of(docs).items()), "word string, n bigint")
    pairs = [(w, b) for batch in spelling._pairs([((0, 5, 2, 0, -1), ["abcde", "abcdf", "abcdef"], [1, 2, 3])]) for w, b in zip(batch.column("word").to_pylist(), batch.column("near").to_pylist())]
    assert sorted(pairs) == [("abcde", "abcdef"), ("abcde", "abcdf"), ("abcdf", "abcdef")]
    assert rows(spelling.group_variants(vocab)) == grouped(words_of(docs))


def test_long_chain_of_forms(spark):
    words = {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 45)}
    got = rows(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    assert got == grouped(words) and {r[2] for r in got} == {"a" * 44}


def test_no_slips_and_other_names(spark):
    docs = spark.createDataFrame([("x", "There there THERE thera thera thera"), ("y", "there there there")], "key string, body string")
    got = {(r["word"], r["root"], r["n"]) for r in spelling.variants(docs, "key", "body", slip=None).collect()}
    assert got == {("there", "there", 6), ("thera", "there", 3)}


def test_very_long_text(spark):
    docs = [(1, "alpha bravo " * 500_000), (2, "alphb " * 3 + "q" * 100_000 + " " + "q" * 100_000 + " " + "q" * 100_000 + " " + ("q" * 99_999 + "r ") * 3)]
    got = {r["word"]: r for r in spelling.variants(frame(spark, docs), slip=None).collect()}
    assert got["alphb"]["root"] == "alpha" and got["alpha"]["n"] == 500_000
    assert got["q" * 100_000]["n_near"] == 1


def test_empty(spark):
    assert rows(spelling.variants(frame(spark, [(1, "x")]).where("false"))) == set()
    assert rows(spelling.variants(frame(spark, [(1, None), (2, ""), (3, "!!")]))) == set()
