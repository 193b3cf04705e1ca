"""Decontamination, toxicity, quality rules and language against brute force or held-out rows."""

import math
import random
import zlib

import brute
import pytest

from annograph.llm import decontaminate, language, quality, queries, toxicity
from annograph.llm.common import table

SF = "/root/testdata/sf0.01"
EXTRA = "row string, words string, hit string, items string, score string, kept string, tally string"


def frame(spark, docs, extra="", values=()):
    schema = f"doc_id bigint, text string, {EXTRA}" + extra
    return spark.createDataFrame([(i, t, *["old"] * 7, *values) for i, t in docs], schema)


def test_contamination(spark):
    rng = random.Random(2)
    words = ["Tau", "rho", "été", "7", "sigma", "pi", "nu"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate((1, 2, 5, 12, 13, 14, 30, 30))] + [(50, None), (51, "..."), (52, ""), (None, "nu nu nu nu nu nu nu")]
    items.append((60, items[6][1]))
    docs = [(1, None), (2, ""), (3, "!!"), (None, make(20)), (5, make(3)), (5, make(3))]
    docs += [(10 + i, " ".join([make(rng.randint(0, 30)), rng.choice(items[:8])[1], make(rng.randint(0, 200))])) for i in range(30)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(brute.contamination(docs, items), key=str)
    for bound in (200_000, 0):
        got = decontaminate.decontaminate(frame(spark, docs), benchmark, remove="nothing", broadcast_windows=bound).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in got), key=str) == want
        assert all(r["n_items"] == len(r["items"]) for r in got)
    kept = decontaminate.decontaminate(frame(spark, docs), benchmark).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(w[0]) for w in want if not w[4])
    assert decontaminate.decontaminate(frame(spark, docs), benchmark.where("false"), remove="nothing").where("n_hit = 0 and not contaminated").count() == len(docs)
    assert decontaminate.decontaminate(frame(spark, docs).where("false"), benchmark).count() == 0


def test_spans_are_cut(spark):
    benchmark = spark.createDataFrame([(1, "red green blue")], "item_id bigint, text string")
    docs = [(1, "Look: RED, green; blue! end."), (2, "red green"), (3, None)]
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(frame(spark, docs), benchmark, remove="spans").collect()}
    assert got == {1: "Look! end.", 2: "red green", 3: None}


@pytest.mark.parametrize(
    "text, folded",
    [
        (None, " "), ("", " "), ("You IDIOT!!", " you idiot "), ("1d10t l0s3r", " idiot loser "), ("mоrоn", " moron "), ("i d i o t", " idiot "),
        ("s.t.u.p.i.d man", " stupid man "), ("ｉｄｉｏｔ", " idiot "), ("in 1999 or 12%", " in 1999 or 12 "), ("i​diot—so", " idiot so "), ("a b c", " a b c "),
    ],
)
def test_fold(text, folded):
    assert toxicity.fold(text) == folded


def test_evidence_and_exceptions():
    matcher = toxicity.build_matcher({"trash": 4.0, "tras": 2.0, "idiot": 5.0}, ("trash can",))
    of = lambda t: toxicity.evidence(matcher, toxicity.fold(t))
    assert of("what trash") == (4.0, 2)
    assert of("the trash can is full") == (0.0, 5)
    assert of("the TRASH-CAN, idiots") == (5.0, 4)
    assert of("extrash") == (0.0, 1)
    assert of("") == (0.0, 0)


def test_toxicity_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert sum(a and b for a, b in held) / sum(a for a, _ in held) > 0.85


def test_toxicity_scores_odd_rows_like_brute_force(spark):
    model = toxicity.Model({"idiot": 5.0, "loser": 4.0}, (), (-4.0, 2.0, 1.0))
    docs = [(1, None), (2, ""), (3, "You 1diot " * 3), (3, "You 1diot " * 3), (None, "calm words"), (4, "x " * 50_000 + "loser")]
    got = toxicity.score_documents(frame(spark, docs), model)
    assert "predicted" in got.columns and got.columns[:9] == frame(spark, docs).columns
    matcher = toxicity.build_matcher(model.weights, ())
    assert [r["score"] for r in got.collect()] == pytest.approx([toxicity.score(model, matcher, t) for _, t in docs])
    none = frame(spark, docs).where("false")
    empty = toxicity.learn(none, none.selectExpr("doc_id", "1 as toxic"))
    assert empty.weights == {} and toxicity.score_documents(frame(spark, docs), empty).where("score < 0.01 and predicted = 0").count() == 6


def js(p, q):
    return math.sqrt(sum(x / 2 * math.log2(x / ((a + b) / 2)) for a, b in zip(p, q) for x in (a, b) if x > 0))


def test_quality(spark):
    rng = random.Random(4)
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    docs += [(-1, None, None), (-2, "", "en"), (-3, " \n \n", "fr"), (-4, "one two three four five six seven eight nine", "xx"), (-5, "a b c d e f g h i j k " * 300, "en"),
             (-5, "a b c d e f g h i j k " * 300, "en"), (None, " ".join(rng.choice("qrstuv") * 3 + "$%" for _ in range(80)), "en"), (-6, "x y z\nx y z\n x y z\n\n", "de")]
    df = spark.createDataFrame([(i, t, lang, "old", "old") for i, t, lang in docs], "doc_id bigint, text string, lang string, kept string, symbol string")
    got = quality.judge(df).collect()
    key = lambda r: (str(r[0]), r[1] or "", r[2] or "")
    got = sorted(got, key=lambda r: key((r["doc_id"], r["text"], r["lang"])))
    docs.sort(key=key)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert [tuple(r[n] for n in names) for r in got] == [brute.quality(t) for _, t, _ in docs]

    def histograms(text):
        text, own = text or "", brute.words(text)
        symbol = sum(c in "#*$%&|<>" for c in text)
        import unicodedata as u

        kinds = [u.category(c) for c in text]
        upper, lower, digit = kinds.count("Lu"), kinds.count("Ll"), kinds.count("Nd")
        space = sum(c in brute.SPACE for c in text)
        return [space, upper, lower, digit, symbol, len(text) - space - upper - lower - digit - symbol], [own.count(w) for w in quality.LISTED], len(own)

    made = [histograms(t) for _, t, _ in docs]
    refs = []
    for lang in quality.COMMON_WORDS:
        rows = [m for m, (_, t, x) in zip(made, docs) if x == lang and not brute.quality(t)[5]]
        if rows:
            classes, listed, total = [sum(c) for c in zip(*[r[0] for r in rows])], [sum(c) for c in zip(*[r[1] for r in rows])], sum(r[2] for r in rows)
            refs.append(([c / sum(classes) for c in classes], [*[w / total for w in listed], 1 - sum(listed) / total]))
    for r, (classes, listed, n) in zip(got, made):
        if r["n_words"] and n:
            assert r["class_distance"] == pytest.approx(min(js([c / sum(classes) for c in classes], q) for q, _ in refs), abs=1e-6)
            assert r["word_distance"] == pytest.approx(min(js([*[w / n for w in listed], 1 - sum(listed) / n], q) for _, q in refs), abs=1e-6)
        near = (r["class_distance"] or 0) <= quality.MAX_CLASS_DISTANCE and (r["word_distance"] or 0) <= quality.MAX_WORD_DISTANCE
        assert r["kept"] == (not r["base_failed"] and (r["n_words"] < 50 or near))
    assert quality.judge(df.where("false")).count() == 0
    assert quality.judge(df.withColumn("lang", df["doc_id"].cast("string"))).where("kept <> (not base_failed)").count() == 0


def test_quality_of_other_languages(spark):
    """Languages without a fixed list get their own words; rare ones are not judged; their junk still goes."""
    rng = random.Random(9)
    script = {"ru": "абвгдежзиклмнопрст", "ar": "ابتثجحخدذرزسشصض", "ko": "가나다라마바사아자차", "en": "abcdefghijklmno"}
    words = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(60)] for x, letters in script.items()}
    text = lambda x: " ".join(rng.choices(words[x], [1 / (k + 1) for k in range(60)], k=rng.randint(60, 150)))
    docs = [(n, text(x), x) for n, x in enumerate(["ru"] * 40 + ["ar"] * 40 + ["ko"] * 5)]
    docs += [(200 + n, " ".join("the of and to in a is that for".split()[rng.randrange(9)] if rng.random() < 0.4 else rng.choice(words["en"]) for _ in range(90)), "en") for n in range(30)]
    docs += [(300, " ".join("".join(rng.choice("#$%0123") for _ in range(6)) for _ in range(90)), "ru")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()}
    assert {i for i, r in got.items() if not r["kept"]} == {300} | {i for i, r in got.items() if r["base_failed"]}
    assert sum(r["base_failed"] for r in got.values()) < 5
    found = quality.frequent_words(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert set(found) == {"ru", "ar"} and all(len(w) == quality.REFERENCE_WORDS for w in found.values())


def test_quality_keeps_good_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    judged = [r for r in queries.op7_quality_rules(spark, SF).collect() if not r["base_failed"] and r["doc_id"] in labels]
    good = [r["kept"] for r in judged if labels[r["doc_id"]] == 1]
    poor = [r["kept"] for r in judged if labels[r["doc_id"]] == 0]
    assert sum(good) / len(good) > 0.995
    assert not poor or sum(poor) < len(poor)


def test_language_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [truth[i] == r["lang_pred"] for i, r in got.items() if r["held_out"]]
    assert sum(held) / len(held) > 0.98


def test_language_of_odd_rows(spark):
    docs = [(1, None, None), (2, "", "en"), (3, "12 ... 3", "en"), (4, "the and of to", "en"), (5, "der und die das", "de"), (6, "le la les et", "fr"), (7, "el los y que", "es")] * 3 + [(None, "日本語", None)]
    df = spark.createDataFrame([(i, t, x, "old") for i, t, x in docs], "doc_id bigint, text string, lang string, score string")
    model = language.learn(df)
    rows = language.identify(df, model).collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(r["lang_pred"] == x for r, (i, _, x) in zip(rows, docs) if i in (4, 5, 6, 7))
    assert rows[-1]["lang_pred"] in ("en", "de", "fr", "es")
    none = language.learn(df.where("false"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(df, none).collect()} == {("und", 0.0)}
    one = language.learn(df.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language.identify(df, one).collect()} == {"und", "en"}
    assert language.identify(df.where("false"), model).count() == 0


def test_language_sample_is_even(spark, monkeypatch):
    sizes = {"en": 30_000, "de": 30_000, "fr": 30_000, "es": 300, "it": 7}
    docs = [(f"{x}{i}", f"{x} word {i % 50}", x) for x, n in sizes.items() for i in range(n)] + [(f"de{i}", "de word again", "de") for i in range(30_000)]
    drawn = []
    monkeypatch.setattr(language, "fit", lambda x, langs: drawn.append(langs.tolist()))
    df = spark.createDataFrame(docs, "doc_id string, text string, lang string")
    for rows, want in ((1000, {"en": 200, "de": 200, "fr": 200, "es": 200, "it": 7}), (3, dict.fromkeys(sizes, 1))):
        language.learn(df, rows=rows)
        assert {x: drawn[-1].count(x) for x in sizes} == want
