"""Toxicity from a learned, weighted lexicon that is matched with one Aho-Corasick pass over folded text."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from annograph.llm.common import unpack

#: Labelled rows that the lexicon and its calibration are learned from, at most.
TRAINING_ROWS = 16_000
MIN_PREFIX, MAX_PREFIX = 4, 12
MIN_DOCS = 5
MIN_WEIGHT = 2.5
PER_DOC = 3

#: Letters of other scripts that look like Latin ones, and digits and signs used in place of letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t",
    "н": "h", "в": "b", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ո": "n", "ս": "u",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "χ": "x", "η": "n", "ω": "w", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "£": "l"}
#: Harmless phrases around words that insult elsewhere, in folded form.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "loser bracket", "sore loser rule", "pond scum", "not stupid", "not worthless")

_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_FULL_WIDTH = {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
_GAPS = [*range(0xA0, 0xAA), *range(0xAB, 0xB5), *range(0xB6, 0xBA), *range(0xBB, 0xC0), 0xD7, 0xF7, *range(0x2000, 0x200B), *range(0x2010, 0x205F), *range(0x3000, 0x3004)]
_RARE = dict.fromkeys(_GAPS, " ") | str.maketrans(HOMOGLYPHS) | _FULL_WIDTH | _INVISIBLE | str.maketrans({c: c for c in SUBSTITUTES if not c.isascii()})
_ANY_RARE = re.compile("[" + "".join(map(re.escape, map(chr, _RARE))) + "]")
#: ASCII letters in lower case, digits and substitutes kept, all else a blank; bytes of other characters stay.
_BYTES = bytes(
    i + 32 if 65 <= i <= 90 else i if i > 127 or chr(i).isalnum() or chr(i) in SUBSTITUTES else 32 for i in range(256)
)
_SUBSTITUTE = str.maketrans(SUBSTITUTES)
_SIGNS = re.compile("[0-9" + "".join(c for c in SUBSTITUTES if not c.isdigit()) + "]+")
_SPELLED = re.compile(r" \w(?: \w){3,}(?= )")


def _as_letters(m: re.Match) -> str:
    """Digits and signs that touch a letter stand for letters."""
    before, after = m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
    return m[0].translate(_SUBSTITUTE) if before.isalpha() or after.isalpha() else m[0]


def fold(text: str | None) -> str:
    """Lower-case words between single blanks, with a blank at both ends; look-alikes, substituted digits and words
    spelled out letter by letter are undone. Digits stay where no letter touches them, so plain numbers are kept."""
    if not text:
        return " "
    if not text.isascii():
        text = text.lower()
        text = text.translate(_RARE) if _ANY_RARE.search(text) else text
    folded = text.encode("utf-8", "replace").translate(_BYTES).decode("utf-8")
    folded = f" {' '.join(_SIGNS.sub(_as_letters, folded).split())} "
    return _SPELLED.sub(lambda m: " " + m[0].replace(" ", ""), folded)


@dataclass(frozen=True)
class Model:
    """`weights` of word beginnings; `scale` turns (evidence, evidence a word) into a logit."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    scale: tuple[float, float, float]


def build_matcher(weights: dict[str, float], exceptions: Sequence[str]) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for term, weight in weights.items():
        found.add_word(" " + term, (len(term), weight))
    for phrase in exceptions:
        found.add_word(f" {phrase} ", (len(phrase) + 1, None))
    if not len(found):
        return None
    found.make_automaton()
    return found


def evidence(matcher: ahocorasick.Automaton | None, folded: str) -> tuple[float, int]:
    """(sum of weights of matched word beginnings outside exception phrases, words). A word counts its best match."""
    words = folded.count(" ") - 1 if folded.strip() else 0
    if matcher is None or not words:
        return 0.0, words
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in matcher.iter(folded):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for start, end in excused:
        for at in [a for a in best if start <= a < end]:
            del best[at]
    return sum(best.values()), words


def features(total: float, words: int) -> np.ndarray:
    return np.array([1.0, math.log1p(total), math.log1p(100 * total / max(words, 20))])


def score(model: Model, matcher: ahocorasick.Automaton | None, text: str | None) -> float:
    z = float(features(*evidence(matcher, fold(text))) @ np.array(model.scale))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of word beginnings by label: documents, and occurrences with at most `PER_DOC` for a document."""
    for batch in batches:
        sums: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        words = [0, 0]
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            own = fold(text).split()
            words[toxic] += len(own)
            seen: Counter[str] = Counter()
            for word, n in Counter(own).items():
                for k in range(MIN_PREFIX, min(len(word), MAX_PREFIX) + 1):
                    seen[word[:k]] += n
            for term, n in seen.items():
                row = sums[term]
                row[toxic] += 1
                row[2 + toxic] += min(n, PER_DOC)
        sums[""] = [0, 0, words[0], words[1]]
        terms = list(sums)
        columns = [pa.array([sums[t][k] for t in terms], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(terms), *columns], names=["term", "d0", "d1", "n0", "n1"])


def choose_terms(rows: Sequence, clean_words: int, toxic_words: int) -> dict[str, float]:
    """Word beginnings whose rate is at least e^`MIN_WEIGHT` times higher in toxic text, without redundant ones.

    A beginning goes if one of its extensions has nearly all its toxic occurrences (the extension is the word), or if a
    kept shorter one weighs about as much.
    """
    rate = math.log((clean_words + 1) / (toxic_words + 1))
    toxic = {r["term"]: r["n1"] for r in rows}
    weight = {r["term"]: math.log((r["n1"] + 0.5) / (r["n0"] + 0.5)) + rate for r in rows}
    longer = {t[:-1] for t in toxic if toxic[t] >= 0.95 * toxic.get(t[:-1], math.inf)}
    kept: dict[str, float] = {}
    for term in sorted((t for t in weight if weight[t] >= MIN_WEIGHT and t not in longer), key=lambda t: (len(t), t)):
        if not any(kept.get(term[:k], 0.0) >= weight[term] - 0.7 for k in range(MIN_PREFIX, len(term))):
            kept[term] = weight[term]
    return kept


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a light ridge."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def _sum_up(weights: dict[str, float], exceptions: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = build_matcher(weights, exceptions)
        for batch in batches:
            found = [evidence(matcher, fold(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())],
                names=["toxic", "total", "words"],
            )

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", exceptions: Sequence[str] = EXCEPTIONS, rows: int = TRAINING_ROWS) -> Model:
    """Lexicon and calibration from at most `rows` labelled documents, those with the smallest hash of their id.

    Three quarters of them choose and weigh the terms, the rest calibrates the score. Only ids of the bounded sample are
    broadcast; counts are summed on the executors. Without a labelled row, or with labels of one kind only, the lexicon
    is empty and the score constant.
    """
    ids = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = ids.withColumn("order", F.xxhash64(id_col)).orderBy("order", id_col).limit(rows).select(F.col(id_col).alias("id"), "toxic", (F.col("order") % 4 == 0).alias("calibrates"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").dropDuplicates(["id"])
    counted = texts.where(~F.col("calibrates")).select("text", "toxic").mapInArrow(_count, "term string, d0 bigint, d1 bigint, n0 bigint, n1 bigint")
    sums = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("d0", "d1", "n0", "n1")])
    found = sums.where((F.col("term") == "") | (F.col("d1") >= MIN_DOCS)).collect()  # terms of the bounded sample
    totals = next((r for r in found if r["term"] == ""), None)
    weights = choose_terms([r for r in found if r["term"]], totals["n0"], totals["n1"]) if totals and totals["n0"] and totals["n1"] else {}
    checked = texts.where("calibrates").select("text", "toxic").mapInArrow(_sum_up(weights, exceptions), "toxic int, total double, words bigint").collect()
    y = np.array([float(r["toxic"]) for r in checked])
    if not len(y) or y.min() == y.max() or not weights:
        return Model({}, tuple(exceptions), (math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -10.0, 0.0, 0.0))
    return Model(weights, tuple(exceptions), _calibrate(np.array([features(r["total"], r["words"]) for r in checked]), y))


def toxicity(text: Column, model: Model) -> Column:
    """Score of a text column, 0 to 1; null and empty texts get the score of no evidence."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = build_matcher(model.weights, model.exceptions)
        for texts in batches:
            yield texts.map(lambda t: score(model, matcher, t)).astype(float)

    return scored(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of `docs` plus `score` (0 to 1) and `predicted` (1 from 0.5). Null and empty texts are scored as texts
    without evidence; equal texts score alike; existing columns of these names are replaced. No other column is read."""
    scored = docs.select(F.struct("*").alias("row"), toxicity(F.col(text_col), model).alias("score"))
    return unpack(scored, {"score": F.col("score"), "predicted": (F.col("score") >= 0.5).cast("int")})
