"""Quality rules: how far a document's character classes and common words diverge from those of its language.

References are the summed histograms of each language's documents that pass the base rules. Words listed for a language are
the fixed ones below or, for every other language with at least `REFERENCE_DOCS` documents, its own most frequent words. A
document is rejected if its Jensen-Shannon distance to every reference is too large; short documents, and those of a
language without a reference, are not judged by histograms.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annograph.llm.common import BETWEEN_VISIBLE, SPACE, let, stored, unpack, words_of

#: Frequent words of the languages with a reference.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in a is that for it was on are as with be by at this from",
    "es": "de la que el en y a los se del las un por con no una su para es al",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec",
}
LISTED = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
#: Documents from which a language outside the fixed lists gets a reference, and the words listed for it.
REFERENCE_DOCS, REFERENCE_WORDS = 20, 24
CLASSES = ("space", "upper", "lower", "digit", "symbol", "other")
#: Words from which a histogram is judged, and the largest distances (0 to 1) to the nearest language.
MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.29
MAX_WORD_DISTANCE = 0.42


def _count(text: Column, others: str) -> Column:
    return F.char_length(F.regexp_replace(text, others, "")).cast("long")


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words in windows of `size` words that occur twice or more, first occurrences included."""

    def covered(g: Column) -> Column:
        ranked = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def spread(s: Column) -> Column:
            def twin(x: Column, j: Column) -> Column:
                return F.coalesce(F.get(s, j - 1)["x"] == x["x"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["x"] == x["x"], F.lit(False))

            starts = F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))
            steps = let(starts, lambda p: F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size)))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(ranked, spread))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) <= size, 0).otherwise(let(windows(h), covered))).cast("long")


def frequent_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The most frequent words of every language that has documents enough and no fixed list: `REFERENCE_WORDS` a language
    reach the driver. Of equally frequent words the first in code-point order is taken."""
    lang = F.col(lang_col).cast("string")
    counts = docs.groupBy(lang.alias("language")).count().where(F.col("language").isNotNull() & ~F.col("language").isin(*COMMON_WORDS) & (F.col("count") >= REFERENCE_DOCS))
    others = [r["language"] for r in counts.collect()]
    if not others:
        return {}
    words = docs.where(lang.isin(*others)).select(lang.alias("language"), F.explode(words_of(F.col(text_col))).alias("word"))
    place = F.row_number().over(W.partitionBy("language").orderBy(F.desc("count"), "word"))
    top = words.groupBy("language", "word").count().withColumn("place", place).where(F.col("place") <= REFERENCE_WORDS)
    found: dict[str, list[str]] = {}
    for r in top.collect():
        found.setdefault(r["language"], []).append(r["word"])
    return found


def _tally(words: Column, listed: Sequence[str]) -> Column:
    """Sorted structs of (number in `listed`, count) of the listed words."""
    every = F.array(*[F.lit(w) for w in listed])
    numbers = F.array_sort(F.transform(F.filter(words, lambda w: w.isin(*listed)), lambda w: F.array_position(every, w).cast("int")))

    def runs(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(F.get(s, i + 1) != x, F.lit(True)), i)), lambda i: i.isNotNull())
        return let(ends, lambda e: F.transform(e, lambda x, i: F.struct(F.get(s, x).alias("w"), (x - F.coalesce(F.get(e, i - 1), F.lit(-1))).cast("long").alias("n"))))

    return let(numbers, runs)


def measure(docs: DataFrame, text_col: str = "text", listed: Sequence[str] = LISTED) -> DataFrame:
    """Packed rows of `docs` with the base counts, `base_failed` and the two histograms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, BETWEEN_VISIBLE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    by_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")
        ),
    )
    by_common = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_plain"), _tally(w, listed).alias("tally")))
    counted = docs.select(
        F.struct("*").alias("row"), by_words.alias("a"), by_common.alias("b"), F.char_length(text).cast("long").alias("chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _count(text, r"[^#*$%&|<>]+").alias("symbol"), _count(text, r"\P{Lu}+").alias("upper"), _count(text, r"\P{Ll}+").alias("lower"), _count(text, r"\P{Nd}+").alias("digit"),
    ).select("*", "a.*", "b.*").drop("a", "b")
    space = F.col("chars") - F.col("word_chars")
    other = F.col("word_chars") - F.col("symbol") - F.col("upper") - F.col("lower") - F.col("digit")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumns({"n_symbols": F.col("symbol"), "space": space, "other": other, "base_failed": failed}).drop("chars")


def references(measured: DataFrame, lang: Column, languages: Sequence[str] = tuple(COMMON_WORDS), listed: Sequence[str] = LISTED) -> dict[str, tuple[list[float], list[float]]]:
    """(class shares, listed word shares and the rest) of each of the languages that has text: at most one row a language
    and one a listed word reach the driver."""
    good = measured.where(~F.col("base_failed") & lang.isin(*languages)).withColumn("language", lang)
    classes = good.groupBy("language").agg(*[F.sum(c).alias(c) for c in (*CLASSES, "n_plain")]).collect()
    words = good.select("language", F.explode("tally").alias("t")).groupBy("language", "t.w").agg(F.sum("t.n").alias("n")).collect()
    found = {}
    for row in classes:
        total, plain = sum(row[c] for c in CLASSES), row["n_plain"]
        if total and plain:
            shares = [0.0] * len(listed)
            for w in words:
                if w["language"] == row["language"]:
                    shares[w["w"] - 1] = w["n"] / plain
            found[row["language"]] = [row[c] / total for c in CLASSES], [*shares, max(0.0, 1 - sum(shares))]
    return found


def _term(p: Column, q: Column | float) -> Column:
    """Both halves of one bin's Jensen-Shannon divergence, in bits."""
    q = q if isinstance(q, Column) else F.lit(q)
    m = (p + q) / 2
    return F.when(p > 0, p / 2 * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q / 2 * F.log2(q / m)).otherwise(0.0)


def _class_distance(shares: list[float]) -> Column:
    total = reduce(Column.__add__, [F.col(c) for c in CLASSES])
    return F.sqrt(F.greatest(F.lit(0.0), reduce(Column.__add__, [_term(F.col(c) / total, q) for c, q in zip(CLASSES, shares)])))


def _word_distance(shares: list[float]) -> Column:
    """Only bins with words are visited; a reference's bins without words of the document add half their share each."""
    known = F.array(*[F.lit(q) for q in shares])
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def add(a: Column, t: Column) -> Column:
        p, q = t["n"] / F.col("n_plain"), F.get(known, t["w"] - 1)
        return F.struct((a["d"] + _term(p, q)).alias("d"), (a["p"] + p).alias("p"), (a["q"] + q).alias("q"))

    def finish(a: Column) -> Column:
        rest = F.greatest(F.lit(0.0), 1 - a["p"])
        return a["d"] + _term(rest, shares[-1]) + F.greatest(F.lit(0.0), 1 - shares[-1] - a["q"]) / 2

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate("tally", start, add, finish)))


def _least(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def judge(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """The columns of `docs` plus `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`, `base_failed`,
    `class_distance`, `word_distance` (to the nearest language) and `kept`.

    Base rules fail a document of under 10 words, or with over a fifth of its words in repeated five-word windows. Of
    the others, those of at least `min_words` words are kept if both distances are within their bounds; shorter ones are
    kept without that test, as are those of a language without a reference, and all where no language has one. Null and
    empty texts have no words and fail. `lang_col` only chooses what a reference is made from and whether there is one; a
    null language makes none, and its documents are compared with all. Equal rows are judged alike; existing columns of
    the added names are replaced.
    """
    lists = {**{x: words.split() for x, words in COMMON_WORDS.items()}, **frequent_words(docs, text_col, lang_col)}
    listed = sorted({w for words in lists.values() for w in words})
    measured = stored(measure(docs, text_col, listed), "measured")
    lang = F.col("row")[lang_col].cast("string")
    known = references(measured, lang, tuple(lists), listed)
    far = {"class_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double")}
    if known:
        worded = F.col("n_plain") > 0
        far = {
            "class_distance": F.when(F.col("n_words") > 0, _least([_class_distance(c) for c, _ in known.values()])),
            "word_distance": F.when(worded, _least([_word_distance(w) for _, w in known.values()])).when(F.col("n_words") > 0, 1.0),
        }
    near = (F.col("class_distance") <= max_class_distance) & (F.col("word_distance") <= max_word_distance)
    kept = ~F.col("base_failed") & ((F.col("n_words") < min_words) | F.coalesce(near, F.lit(True)))
    if known:
        kept = kept | (~F.col("base_failed") & F.coalesce(~lang.isin(*known), F.lit(False)))
    judged = measured.withColumns(far).withColumn("kept", kept)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")
    return unpack(judged, {n: F.col(n) for n in names})
