"""Language of a text in two steps: its family, then one-versus-one machines between the languages of the family."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from annograph.llm.common import unpack

#: Labelled rows that the machines are trained on, at most, over all languages (one row of each, if there are more languages).
TRAINING_ROWS = 2400
#: Different places in the order that rows are drawn in.
ORDERS = 1_000_003
BUCKETS = 4096
UNKNOWN = "und"
_CHUNK = 4_000_000
_DOCS = 2000

#: Families of languages by code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur mr gu pa ne si",
    "semitic": "ar he mt am",
    "east_asian": "zh ja ko",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[i for i in range(128) if not (65 <= i <= 90 or 97 <= i <= 122)]] = 32


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def has_letter(text: bytes) -> bool:
    data = np.frombuffer(text, np.uint8)
    if (_PLAIN[data] != 32).any():
        return bool((data < 128).any() and ((_PLAIN[data] != 32) & (data < 128)).any()) or any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return False


def profiles(texts: Sequence[bytes]) -> np.ndarray:
    """A row for each text: hashed counts of all its byte trigrams (lower-cased, other ASCII as blanks), as unit vectors
    of square roots."""
    made = np.zeros((len(texts), BUCKETS), np.float32)
    sizes = np.array([len(t) for t in texts], np.int64)
    i = 0
    while i < len(texts):
        j = i + 1
        total = sizes[i]
        while j < len(texts) and total + sizes[j] <= _CHUNK:
            total += sizes[j]
            j += 1
        data = _PLAIN[np.frombuffer(b" ".join(texts[i:j]), np.uint8)].astype(np.uint32)
        if len(data) > 2:
            grams = data[:-2] * np.uint32(65599 * 65599 % 2**32) + data[1:-1] * np.uint32(65599) + data[2:]
            slots = ((grams * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
            blank = (data[:-2] == 32) & (data[1:-1] == 32)
            begin = 0
            for row, size in zip(range(i, j), sizes[i:j]):
                own = slots[begin : begin + max(0, size - 2)]
                made[row] = np.bincount(own[~blank[begin : begin + len(own)]], minlength=BUCKETS)
                begin += size + 1
        i = j
    made = np.sqrt(made)
    return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Model:
    """One machine for each pair of families and of languages inside a family: `left` against `right`, weights, bias."""

    families: tuple[str, ...]
    languages: dict[str, tuple[str, ...]]
    machines: dict[tuple[str, str], tuple[np.ndarray, float]]


def train_machine(x: np.ndarray, y: np.ndarray, rounds: int = 200, strength: float = 20.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, both classes weighing the same; accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1 / (1 + 2 * strength * 2))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        gradient = v - np.float32(2 * strength) * ((share * y * slack) @ x)
        new = v - rate * gradient
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1].astype(np.float32), float(w[-1])


def _between(names: Sequence[str], x: np.ndarray, owner: np.ndarray) -> dict:
    made = {}
    for left, right in combinations(names, 2):
        rows = (owner == left) | (owner == right)
        made[left, right] = train_machine(x[rows], np.where(owner[rows] == left, 1.0, -1.0))
    return made


def fit(x: np.ndarray, langs: np.ndarray) -> Model:
    known = sorted(set(langs.tolist()))
    families = tuple(sorted({family(x) for x in known}))
    owner = np.array([family(x) for x in langs.tolist()], dtype=object)
    languages = {f: tuple(x for x in known if family(x) == f) for f in families}
    machines = {("family:" + a, "family:" + b): m for (a, b), m in _between(families, x, owner).items()}
    for f in families:
        rows = owner == f
        machines |= _between(languages[f], x[rows], langs[rows])
    return Model(families, languages, machines)


def _vote(names: Sequence[str], prefix: str, margins: dict) -> tuple[np.ndarray, np.ndarray]:
    """Winner of the most pairs, then of the largest margins (index into `names`), and its smallest margin."""
    rows = next(iter(margins.values())).shape[0] if margins else 0
    votes = np.zeros((rows, len(names)))
    least = np.full((rows, len(names)), np.inf)
    for i, j in combinations(range(len(names)), 2):
        m = margins[prefix + names[i], prefix + names[j]]
        votes[:, i] += (m >= 0) + 1e-3 * np.tanh(m)
        votes[:, j] += (m < 0) - 1e-3 * np.tanh(m)
        least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
    best = votes.argmax(axis=1)
    return best, least[np.arange(rows), best]


def classify(model: Model, texts: Sequence[bytes]) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1) of each text; `und` and 0 without a letter or without a trained language."""
    names = np.full(len(texts), UNKNOWN, dtype=object)
    scores = np.zeros(len(texts))
    lettered = np.array([has_letter(t) for t in texts], bool)
    if not model.families or not lettered.any():
        return names.tolist(), scores
    x = profiles([t for t, ok in zip(texts, lettered) if ok])
    margins = {pair: x @ w + b for pair, (w, b) in model.machines.items()}
    rows = len(x)
    chosen, margin = _vote(model.families, "family:", margins) if len(model.families) > 1 else (np.zeros(rows, int), np.full(rows, np.inf))
    found = np.full(rows, UNKNOWN, dtype=object)
    for k, f in enumerate(model.families):
        own = np.flatnonzero(chosen == k)
        if len(model.languages[f]) == 1:
            found[own] = model.languages[f][0]
            continue
        best, inner = _vote(model.languages[f], "", {p: m[own] for p, m in margins.items()})
        found[own] = np.array(model.languages[f], dtype=object)[best]
        margin[own] = np.minimum(margin[own], inner)
    names[lettered] = found
    scores[lettered] = 1 / (1 + np.exp(-4 * np.clip(margin, -100, 100)))
    return names.tolist(), scores


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), _DOCS):
            some = batch.slice(i, _DOCS)
            rows = profiles([t or b"" for t in some.column("data").to_pylist()])
            made = pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in ("order", "lang", "id")], made], names=["order", "lang", "id", "profile"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAINING_ROWS) -> Model:
    """Train on up to `rows` documents with a language and a letter, spread evenly over the languages.

    Each language gives the `rows / languages` ids of the smallest hashes, and one at least; a language with fewer ids
    gives them all. Ids must not be null; a repeated id counts once. Only the ids of the sample are broadcast. Profiles
    are made on the executors; the driver gets 8 KB for each chosen row. Without any labelled row the model knows no language.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    order = F.pmod(F.xxhash64("id", "lang"), F.lit(ORDERS)).alias("order")
    narrow = labelled.where("id is not null").select("id", "lang", order)
    counts = {r["lang"]: r["n"] for r in narrow.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("n")).collect()}
    if not counts:
        return Model((), {}, {})
    quota = max(1, rows // len(counts))
    # So many ids are ranked that a language practically never has fewer than its quota among them: six standard
    # deviations of the draw, and ten of the count.
    ranked = 1.2 * (quota + 6 * quota**0.5 + 20)
    below = docs.sparkSession.createDataFrame([(x, int(min(1.0, ranked / n) * ORDERS) + 1) for x, n in counts.items()], "lang string, below bigint")
    drawn = narrow.join(F.broadcast(below), "lang").where("order < below").select("id", "lang", "order").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "id"))
    sample = drawn.withColumn("place", place).where(F.col("place") <= quota).drop("place")
    chosen = labelled.join(F.broadcast(sample), ["id", "lang"]).select("order", "lang", F.col("id"), F.col("text").cast("binary").alias("data"))
    kind = chosen.schema["id"].dataType.simpleString()
    profiled = chosen.mapInArrow(_profile, f"order bigint, lang string, id {kind}, profile binary")
    found = profiled.groupBy("lang", "order", "id").agg(F.min("profile").alias("profile")).orderBy("order", "lang", "profile").collect()
    x = np.stack([np.frombuffer(r["profile"], np.float16).astype(np.float32) for r in found])
    return fit(x, np.array([r["lang"] for r in found], dtype=object))


def language(text: Column, model: Model) -> Column:
    """Struct of `lang` and `score` of a text column."""

    @F.arrow_udf("struct<lang string, score double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names: list[str] = []
            scores = [np.zeros(0)]
            for i in range(0, len(texts), _DOCS):
                own, sure = classify(model, [t or b"" for t in texts.slice(i, _DOCS).to_pylist()])
                names += own
                scores.append(sure)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=["lang", "score"])

    return predicted(F.coalesce(text, F.lit("")).cast("binary"))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of `docs` plus `lang_pred` and `score`. Null texts and texts without a letter are `und` with score 0;
    equal texts get equal answers; existing columns of these names are replaced. No other column is read."""
    found = docs.select(F.struct("*").alias("row"), language(F.col(text_col), model).alias("x"))
    return unpack(found, {"lang_pred": F.col("x.lang"), "score": F.col("x.score")})
