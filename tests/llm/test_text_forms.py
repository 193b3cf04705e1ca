"""Sampled pieces, main text of pages and chat formatting."""

import html
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annograph.llm import chat, html_text, pieces
from annograph.llm.common import table

TEXTS = ["", " ", "  a", "Hello  world▁x\n\té日 ", "\n\n", "a" * 300, "日本語のテキスト😀 ok", "x \n y", "dońt\r\n\x00z", "▁ ▁▁", " ", "q" * 70_000 + " " + "日" * 3000]


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces.MODEL)


def split(ids, n):
    ends = np.r_[0, np.cumsum(n)]
    return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


def test_round_trip(vocab):
    ids, n = pieces.encode_texts(TEXTS, np.arange(len(TEXTS)), vocab)
    assert [pieces.decode_ids(x, vocab) for x in split(ids, n)] == TEXTS
    alone = [pieces.encode_texts([t], np.array([i]), vocab)[0].tolist() for i, t in enumerate(TEXTS)]
    assert alone == [x.tolist() for x in split(ids, n)]


@pytest.mark.parametrize("word", ["there", "日語xé", "qqq"])
def test_draws_follow_the_lattice(vocab, word):
    by_bytes = {b: i for i, b in enumerate(vocab.bytes_of) if len(b) > 0 and i not in set(vocab.byte_ids.tolist())}

    def paths(text):
        if not text:
            yield (), 0.0
        for k in range(1, len(text) + 1):
            head = text[:k].encode()
            if head in by_bytes:
                options = [((by_bytes[head],), vocab.weight[by_bytes[head]])]
            elif k == 1:
                options = [(tuple(vocab.byte_ids[list(head)].tolist()), len(head) * vocab.byte_weight)]
            else:
                continue
            for (ids, w), (rest, more) in itertools.product(options, paths(text[k:])):
                yield ids + rest, w + more

    weights = {ids: math.exp(w) for ids, w in paths(" " + word)}
    total, draws = sum(weights.values()), 20_000
    ids, n = pieces.encode_texts([word] * draws, np.arange(draws), vocab)
    seen = Counter(tuple(x.tolist()) for x in split(ids, n))
    assert set(seen) <= set(weights)
    assert max(abs(seen[s] / draws - w / total) for s, w in weights.items()) < 0.02


def test_tokenize(spark):
    docs = [(i, t, "old") for i, t in enumerate(TEXTS)] + [(0, None, "old"), (5, "a" * 300, "old"), (5, "a" * 300, "old"), (None, "null id", "old")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, ids string")
    coded = pieces.tokenize(df).withColumn("back", pieces.decode(F.col("ids")))
    rows = coded.collect()
    assert coded.columns == ["doc_id", "text", "ids", "n_ids", "back"]
    assert [r["back"] for r in rows] == [t or "" for _, t, _ in docs]
    again = {(r["doc_id"], r["text"]): r["ids"] for r in pieces.tokenize(df.repartition(7)).collect()}
    assert all(again[r["doc_id"], r["text"]] == r["ids"] and r["n_ids"] == len(r["ids"]) for r in rows)
    other = {(r["doc_id"], r["text"]): r["ids"] for r in pieces.tokenize(df, seed=1).collect()}
    assert any(other[k] != v for k, v in again.items())
    assert pieces.tokenize(df.where("false")).count() == 0
    assert df.select(pieces.decode(F.lit(None).cast("array<int>")).alias("x")).where("x <> ''").count() == 0


def test_pages_of_the_test_table(spark):
    got = html_text.extract_pages(table(spark, "/root/testdata/sf0.01", "pages")).collect()
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        assert r["text"] == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("a < b &amp; c", "a < b & c"), ("<p", ""), ("<script>x", ""), ("<style>p{}</style><p>a&nbsp; b<br>c</p>", "a b c"),
        ('<div id=main><div class="nav-menu"><a>x</a></div><div><p>Hello <b>wor</b>ld</p><p>Second</p></div></div><div class=comments><p>me</p></div>', "Hello world\nSecond"),
        ("<ul><li><a href=x>Home</a><li><a href=y>About</a></ul><div><div><h1>Title</h1><p>Body text.</p><p>Tail</p></div></div><footer>f</footer>", "Title\nBody text.\nTail"),
        ('<article><h1>T</h1><aside>no</aside><p>a<p>b<figure><img src="a>b"><figcaption>cap</figcaption></figure><section class="comments"><article>c</article></section></article>', "T\na\nb\ncap"),
        ("<article>x<form>y</article>", "x"), ("<nav>n</nav><p>first</p><div hidden>h</div><!-- c --><p>last", "first\nlast"), ("<p>one</p><div class='has-sidebar'><p>two</p></div>", "one\ntwo"),
        ("<div class=cookie-notice>We use cookies, a lot of them, and more of them.</div><main><p>m</p></main>", "m"), ("<p>&#x41;&#66;&bogus;</p>", "AB&bogus;"),
    ],
)
def test_pages(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<section><div><p>A one</p></div></section><section><div><p>B</p></div></section>", "A one\nB"),
        ("<div><div><p>A</p></div><div class=advert><p>Buy</p></div><div><p>B</p><ul><li>c</ul></div></div>", "A\nB\nc"),
        ("<main><article>A</article><article>B two</article></main>", "A\nB two"),
        ("<main><section><div><article><p>A</p></article></div></section><p>between<section><article><p>B</p></article></section></main><p>out", "A\nbetween\nB"),
        ("<article><p>A</p></article><div><ul><li>out</ul></div><article><p>B</p></article>", "A\nB"),
        ("<p>A</p></div></div><div><div><a href=x>link</a><p>B", "A\nlink\nB"),
        ("<div><ul><li><a>Home</a><li><a>News</a></ul></div><div><div><p>A</p></div></div><div><ul><li><a>Home</a><li><a>News</a></ul></div><div><div><p>B</p></div></div><ul><li><a>x</a></ul>", "A\nB"),
        ("<table><tr><td>" + "</td></tr></table><div><table><tr><td>".join("abcdef") + "</table>", "a\nb\nc\nd\ne\nf"),
        ("<article></article><div><div><div><p>A</p></div></div></div><div><div><p>B", "A\nB"),
    ],
)
def test_all_stretches_of_a_page(page, text):
    assert html_text.extract(page) == text


SENTENCE = "A sentence of the article with words enough to count as text, and a few more of them. "
WHOLE = SENTENCE.strip()


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h2>Teaser</h2></article><div><p>{SENTENCE * 3}</p><p>{SENTENCE * 4}</p></div>", f"{(SENTENCE * 3).strip()}\n{(SENTENCE * 4).strip()}"),
        (f"<p class='notice'>Cookie<p>{SENTENCE}", WHOLE),
        (f"<ul><li class='share'>Tweet<li>item</ul><div><p>{SENTENCE}", f"item\n{WHOLE}"),
        (f"<div class='layout-sidebar'><p>{SENTENCE}</p></div>", WHOLE),
        (f"<div class='sidebar'><div class=menu><p>x</p></div><p>{SENTENCE}</p></div>", WHOLE),
        (f"<div class='sidebar'><p>short</p></div><p>{SENTENCE}</p>", WHOLE),
        (f"<div class='entry-header'><h1>Headline</h1></div><p>{SENTENCE}</p>", f"Headline\n{WHOLE}"),
        (f"<div><div><div><p>{SENTENCE * 3}</p></div></div></div><div><div><div><p>Copyright</p></div></div></div>", (SENTENCE * 3).strip()),
        (f"<div><a>Home</a> | <a>News</a> | <a>Sports</a></div><div><p>{SENTENCE}</p></div>", WHOLE),
        ("<table><tr class=ad><td>x<td>y<tr><td>a<td>b</table>", "a\nb"),
        ("<dl><dt>t<dd class=promo>buy<dd>d</dl>", "t\nd"),
        ("<div><form><p>x</div><p>y", "y"),
    ],
)
def test_weights_of_lines(page, text):
    assert html_text.extract(page) == text


def test_stretches_by_definition():
    """Window sums and stretches stated anew, on pages of random parts."""
    draw = random.Random(5)
    pieces_of = ["<div>", "</div>", "<section>", "</section>", "<p>", "</p>", "<ul><li>", "</ul>", "<article>", "</article>", "<a>link</a>", "x", "some words here ", SENTENCE * 2]
    for _ in range(500):
        page = "".join(draw.choice(pieces_of) for _ in range(draw.randint(1, 60)))
        lines = html_text.lines_of(page)
        window = lambda i: [x for x in lines[max(0, i - html_text.WINDOW + 1) : i + 1]]
        sums = [sum(x.weight for x in window(i)) for i in range(len(lines) + html_text.WINDOW)]
        peak = sums.index(max(sums))
        factor = html_text.ARTICLE_WEIGHT if any(x.weight > len(x.text) for x in window(peak)) else 1
        threshold = html_text.SHARE * min(max(sums), html_text.ENOUGH * factor)
        out = []
        for _, run in itertools.groupby(range(len(sums)), lambda i: sums[i] > 0):
            run = list(run)
            if sums[run[0]] > 0 and max(sums[i] for i in run) >= threshold:
                last = max(i for i in run if i < len(lines) and lines[i].weight)
                behind = list(itertools.takewhile(lambda x: x.text, lines[last + 1 : last + html_text.WINDOW]))
                out += [x.text for x in lines[run[0] : last + 1] + behind if x.text]
        assert html_text.extract(page) == "\n".join(out), page


def test_deep_page():
    assert html_text.extract("<div>" * 20_000 + "x" + "</section>" * 20_000) == "x"


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, None, "old"), (2, "<p>" + "word " * 100_000, "old")], "page_id bigint, html string, text string")
    assert sorted(r["n_chars"] for r in html_text.extract_pages(df).collect()) == [0, 0, 499_999]
    assert html_text.extract_pages(df.where("false")).count() == 0


def test_chats(spark):
    messages = spark.createDataFrame(
        [("c", 0, "user", "q", "old"), ("c", 1, "assistant", None, "old"), ("c", 2, "user", 'a "b"\n', "old"), (None, None, None, None, "old"), ("d", 0, "user", "x", "old"), ("d", 0, "user", "x", "old")],
        "conv_id string, turn bigint, role string, text string, place string",
    )
    calls = spark.createDataFrame(
        [
            ("c", 1, "late", "f", '{"b": 1, "a": "x"}', "early2"), ("c", 3, "early2", "f", '{"a": "y"}', None), ("c", 3, "early2", "f", '{"a": "z"}', None), ("c", 4, "bad", "f", "{", None),
            ("c", 5, "l1", "f", '{"a": 3, "zz": null}', "l2"), ("c", 6, "l2", "g", "{}", "l1"), ("c", 7, "self", "f", '{"a":"s"}', "self"), ("c", 8, None, "f", "{}", None), ("c", 8, "arr", "f", "[1]", "gone"),
        ],
        "conv_id string, turn bigint, call_id string, name string, arguments string, needs string",
    )
    results = spark.createDataFrame(
        [("c", 2, "late", "r1"), ("c", 9, "late", "r2"), ("c", 4, "early2", None), ("c", 5, "nobody", "r"), ("e", 1, None, "r")], "conv_id string, turn bigint, call_id string, content string"
    )
    schemas = spark.createDataFrame([("f", "a", "string", True), ("f", "b", "integer", False)], "name string, field string, type string, required boolean")
    rows = chat.format_chats(messages, calls, results, schemas).collect()
    assert len(rows) == 6 + 8 + 5
    c = sorted((r for r in rows if r["conv_id"] == "c"), key=lambda r: r["position"])
    assert [r["position"] for r in c] == list(range(1, len(c) + 1))
    at = {(r["role"], r["call_id"], r["status"]): r for r in c}
    assert at["assistant", "early2", "linked"]["position"] < at["assistant", "late", "linked"]["position"] < at["tool", "late", "linked"]["position"]
    assert at["assistant", "late", "linked"]["json"] == r'{"arguments":"{\"a\":\"x\",\"b\":1}","id":"late","name":"f","role":"assistant"}'
    assert at["assistant", "late", "linked"]["depth"] == 1
    assert ("assistant", "early2", "duplicate_id") in at and ("tool", "late", "repeated") in at and ("tool", "nobody", "orphan") in at
    assert {k[1] for k in at if k[2] == "cycle"} == {"l1", "l2", "self"}
    assert at["assistant", "bad", "no_result"]["errors"] == ["arguments:unreadable"] == at["assistant", "arr", "no_result"]["errors"]
    assert at["assistant", "l1", "cycle"]["errors"] == ["type:a", "unknown:zz"]
    assert at["assistant", "l2", "cycle"]["errors"] == ["tool:unknown"]
    assert [r["json"] for r in c if r["status"] == "plain"] == ['{"content":"q","role":"user"}', '{"role":"assistant"}', r'{"content":"a \"b\"\n","role":"user"}']
    assert sorted(r["position"] for r in rows if r["conv_id"] == "d") == [1, 2]
    none = chat.format_chats(messages.where("false"), calls.where("false"), results.where("false"), schemas.where("false"))
    assert none.count() == 0


def test_long_chains_of_calls(spark):
    calls = spark.range(300).selectExpr("'c' as conv_id", "300 - id as turn", "concat('k', id) as call_id", "if(id > 0, concat('k', id - 1), null) as needs")
    got = {r["call_id"]: (r["place"], r["depth"], r["cyclic"]) for r in chat.order_calls(calls).collect()}
    assert got == {f"k{i}": (300, i, False) for i in range(300)}


def test_large_turns_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat._positions, "__defaults__", (50,))
    turns = [("big", None, "user", f"m{i % 90}") for i in range(120)] + [("c", 2**31 + 5, "user", "late"), ("c", 1, "user", "soon"), ("c", -(2**40), "user", "first")]
    messages = spark.createDataFrame(turns, "conv_id string, turn bigint, role string, text string")
    none = lambda schema: spark.createDataFrame([], schema)
    calls, results = none("conv_id string, turn bigint, call_id string, name string, arguments string, needs string"), none("conv_id string, turn bigint, call_id string, content string")
    rows = chat.format_chats(messages, calls, results, none("name string, field string, type string, required boolean")).collect()
    by = lambda conv: [r["json"] for r in sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["position"])]
    assert [j.split('"')[3] for j in by("c")] == ["first", "soon", "late"]
    assert by("big") == sorted(by("big")) and len(by("big")) == 120
    assert sorted(r["position"] for r in rows if r["conv_id"] == "big") == list(range(1, 121))
