"""Registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from annograph.llm import chat, decontaminate, html_text, language, line_dedup, mix, near_dedup, pieces, quality, spelling, suffix_dedup, toxicity, whiten
from annograph.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def digest(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


@query(
    "op1_line_dedup",
    """
WITH lines AS (
  SELECT doc_id, i AS pos, l[i] AS line,
         translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT lines.*, coalesce(shared.keeper <> doc_id, false) AS dropped FROM lines LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def op1_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", digest(F.col("text")).alias("kept_sha256"))


@query(
    "op2_decontaminate",
    r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 13) AS k FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)
), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)
), h AS (
  SELECT doc_id, i, k, item_id FROM dw JOIN g USING (k, gram)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
""",
)
def op2_decontaminate(spark, sf_dir):
    marked = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), remove="nothing")
    return marked.select("doc_id", "n_words", "n_hit", "n_items", digest(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


@query("op4_near_dedup")
def op4_near_dedup(spark, sf_dir):
    return near_dedup.assign_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the id as text has this remainder; null ids never do."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(~held_out(5, 0)))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


@query("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    coded = pieces.tokenize(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select(
        "doc_id", "n_ids", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


@query(
    "op10_suffix_dedup",
    """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, b, substring(h, 2 * b + 1, 2 * (512 + 199)) AS s, length(h) // 2 - 199 AS n
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199, 512)) AS b FROM d WHERE length(h) >= 400)),
w AS (SELECT doc_id, b + o AS i, md5(substring(s, 2 * o + 1, 400)) AS k FROM (SELECT doc_id, b, s, unnest(range(0, least(512, n - b))) AS o FROM blocks)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
s AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS fresh FROM r),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s) GROUP BY doc_id, run),
parts AS (
  SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS begin, a AS stop FROM runs
  UNION ALL
  SELECT doc_id, length(h) AS a, coalesce((SELECT max(b) FROM runs WHERE runs.doc_id = d.doc_id), 0), length(h) // 2 FROM d),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * begin + 1, 2 * (stop - begin)), '' ORDER BY a) AS k FROM parts JOIN d USING (doc_id) GROUP BY doc_id),
lost AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
""",
)
def op10_suffix_dedup(spark, sf_dir):
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~held_out(4, 2)))
    return language.identify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


@query("op8_html_extraction")
def op8_html_extraction(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def _js(p, q):
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} / 2 * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"{half(p)} + {half(q)}"


LISTED_SQL = ", ".join(f"('{w}')" for w in quality.LISTED)
LANGS_SQL = ", ".join(f"'{x}'" for x in quality.COMMON_WORDS)


@query(
    "op7_quality_rules",
    rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS plain FROM t),
others AS (SELECT lang, word FROM (
  SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place FROM (SELECT lang, unnest(plain) AS word FROM w)
  WHERE lang IN (SELECT lang FROM t GROUP BY lang HAVING count(*) >= {quality.REFERENCE_DOCS}) AND lang NOT IN ({LANGS_SQL}) GROUP BY lang, word) WHERE place <= {quality.REFERENCE_WORDS}),
listed AS (SELECT word FROM (VALUES {LISTED_SQL}) fixed(word) UNION SELECT word FROM others),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w) AS base_failed, length(text) AS chars, len(plain) AS n_plain,
    length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS upper, length(regexp_replace(text, '\P{{Ll}}+', '', 'g')) AS lower, length(regexp_replace(text, '\P{{Nd}}+', '', 'g')) AS digit
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
bins AS (
  SELECT doc_id, bin, n FROM (SELECT doc_id, chars - word_chars AS c1, upper AS c2, lower AS c3, digit AS c4, n_symbols AS c5, word_chars - n_symbols - upper - lower - digit AS c6 FROM m)
  UNPIVOT (n FOR bin IN (c1, c2, c3, c4, c5, c6))),
good AS (SELECT doc_id, lang FROM m WHERE NOT base_failed AND (lang IN ({LANGS_SQL}) OR lang IN (SELECT lang FROM others))),
qc AS (SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM bins JOIN good USING (doc_id) GROUP BY lang, bin),
class AS (
  SELECT doc_id, min(d) AS d FROM (
    SELECT doc_id, lang, sqrt(greatest(0, sum({_js("p", "q")}))) AS d FROM (SELECT doc_id, bin, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM bins) JOIN qc USING (bin) GROUP BY doc_id, lang)
  GROUP BY doc_id),
tally AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(plain) AS word FROM w) JOIN listed USING (word) GROUP BY doc_id, word),
total AS (SELECT lang, sum(n_plain) AS n FROM good JOIN m USING (doc_id, lang) GROUP BY lang),
seen AS (SELECT lang, word, sum(tally.n) AS n FROM good JOIN tally USING (doc_id) GROUP BY lang, word),
qw AS (SELECT total.lang, word, coalesce(seen.n, 0) / total.n AS q FROM total CROSS JOIN listed LEFT JOIN seen USING (lang, word)),
rest AS (SELECT lang, greatest(0, 1 - sum(q)) AS q FROM qw GROUP BY lang),
near AS (
  SELECT doc_id, lang, sum({_js("p", "q")}) AS d, sum(p) AS p, sum(q) AS q
  FROM (SELECT tally.doc_id, word, tally.n / n_plain AS p FROM tally JOIN m USING (doc_id)) JOIN qw USING (word) GROUP BY doc_id, lang),
word AS (
  SELECT doc_id, min(sqrt(greatest(0, d + {_js("p", "q")} + greatest(0, 1 - q - seen_q) / 2))) AS d
  FROM (SELECT m.doc_id, rest.lang, coalesce(d, 0) AS d, greatest(0, 1 - coalesce(near.p, 0)) AS p, rest.q, coalesce(near.q, 0) AS seen_q
        FROM m CROSS JOIN rest LEFT JOIN near ON near.doc_id = m.doc_id AND near.lang = rest.lang WHERE n_plain > 0)
  GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {quality.MIN_WORDS} OR (lang IS NOT NULL AND lang NOT IN (SELECT lang FROM total)) OR (coalesce(class.d, 0) <= {quality.MAX_CLASS_DISTANCE} AND CASE WHEN n_plain = 0 THEN 1 ELSE coalesce(word.d, 0) END <= {quality.MAX_WORD_DISTANCE})) AS kept
FROM m LEFT JOIN class USING (doc_id) LEFT JOIN word USING (doc_id)
""",
)
def op7_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


TOOL_FIELDS = (
    ("lookup", "exact", "boolean", True), ("lookup", "query", "string", True), ("search", "limit", "integer", True), ("search", "query", "string", True),
    ("search", "exact", "boolean", False), ("translate", "limit", "number", False), ("translate", "exact", "boolean", True), ("translate", "query", "string", True),
)


def tool_turns(conversations):
    """(calls, results) made from turns: each assistant turn calls a tool, the user turn behind it brings the result."""
    t = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.char_length("text"))
    ident = lambda turn: F.concat_ws("_", F.lit("call"), "conv_id", turn)
    args = F.struct(
        F.when(F.col("n") % 7 != 0, F.col("text")).alias("query"),
        F.when(F.col("n") % 5 != 0, F.col("n")).alias("limit"),
        F.when(F.col("n") % 11 == 0, F.lit("x")).alias("note"),
        (F.col("n") % 2 == 0).alias("exact"),
    )
    name = F.when(F.col("n") % 13 == 0, "teleport").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("search", "lookup", "translate")]), (F.col("n") % 3 + 1).cast("int")))
    needs = ident(F.when(F.col("conv_id") % 7 == 0, F.col("turn") + 2).otherwise(F.col("turn") - 2))
    calls = t.where("role = 'assistant'").select("conv_id", "turn", ident(F.col("turn")).alias("call_id"), name.alias("name"), F.to_json(args).alias("arguments"), needs.alias("needs"))
    results = t.where("role = 'user' and turn > 0").select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


@query(
    "op5_chat_formatting",
    """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations),
fields(name, field, kind, required) AS (VALUES ('lookup', 'exact', 'b', true), ('lookup', 'query', 's', true), ('search', 'limit', 'i', true), ('search', 'query', 's', true),
  ('search', 'exact', 'b', false), ('translate', 'limit', 'i', false), ('translate', 'exact', 'b', true), ('translate', 'query', 's', true)),
calls AS (
  SELECT conv_id, turn, n, 'call_' || conv_id || '_' || turn AS call_id,
    CASE WHEN n % 13 = 0 THEN 'teleport' WHEN n % 3 = 0 THEN 'search' WHEN n % 3 = 1 THEN 'lookup' ELSE 'translate' END AS name,
    '{"exact":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || CASE WHEN n % 5 <> 0 THEN ',"limit":' || n ELSE '' END
      || CASE WHEN n % 11 = 0 THEN ',"note":"x"' ELSE '' END || CASE WHEN n % 7 <> 0 THEN ',"query":' || CAST(to_json(text) AS VARCHAR) ELSE '' END || '}' AS arguments,
    turn + CASE WHEN conv_id % 7 = 0 THEN 2 ELSE -2 END AS other
  FROM t WHERE role = 'assistant'),
results AS (SELECT conv_id, turn, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text FROM t WHERE role = 'user' AND turn > 0),
given AS (
  SELECT conv_id, turn, unnest(list_filter([CASE WHEN n % 7 <> 0 THEN 'query' END, CASE WHEN n % 5 <> 0 THEN 'limit' END, CASE WHEN n % 11 = 0 THEN 'note' END, 'exact'], lambda x: x IS NOT NULL)) AS field FROM calls),
findings AS (
  SELECT conv_id, turn, 'missing:' || field AS e FROM calls JOIN fields USING (name) WHERE required AND NOT EXISTS (SELECT 1 FROM given g WHERE g.conv_id = calls.conv_id AND g.turn = calls.turn AND g.field = fields.field)
  UNION ALL
  SELECT conv_id, turn, 'unknown:' || field FROM calls JOIN given USING (conv_id, turn) WHERE name <> 'teleport' AND NOT EXISTS (SELECT 1 FROM fields f WHERE f.name = calls.name AND f.field = given.field)
  UNION ALL
  SELECT conv_id, turn, 'tool:unknown' FROM calls WHERE name = 'teleport'),
errs AS (SELECT conv_id, turn, string_agg(e, ',' ORDER BY e) AS errors FROM findings GROUP BY ALL),
chain AS (
  SELECT conv_id, call_id, turn AS place, 0 AS depth, other FROM calls
  UNION ALL
  SELECT chain.conv_id, chain.call_id, greatest(place, c.turn), depth + 1, c.other FROM chain JOIN calls c ON c.conv_id = chain.conv_id AND c.turn = chain.other),
placed AS (SELECT conv_id, call_id, max(place) AS place, max(depth) AS depth FROM chain GROUP BY ALL),
every AS (
  SELECT conv_id, turn, role, NULL AS call_id, turn AS place, 0 AS depth, 0 AS kind, 'plain' AS status, '' AS errors,
    '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS json FROM t
  UNION ALL
  SELECT c.conv_id, c.turn, 'assistant', c.call_id, place, depth, 1, CASE WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END, coalesce(errors, ''),
    '{"arguments":' || CAST(to_json(arguments) AS VARCHAR) || ',"id":"' || c.call_id || '","name":"' || name || '","role":"assistant"}'
  FROM calls c JOIN placed USING (conv_id, call_id) LEFT JOIN errs e ON e.conv_id = c.conv_id AND e.turn = c.turn LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
  UNION ALL
  SELECT r.conv_id, r.turn, 'tool', r.call_id, coalesce(place, r.turn), coalesce(depth, 0), 2, CASE WHEN p.call_id IS NULL THEN 'orphan' ELSE 'linked' END, '',
    '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"tool","tool_call_id":"' || r.call_id || '"}'
  FROM results r LEFT JOIN placed p ON p.conv_id = r.conv_id AND p.call_id = r.call_id)
SELECT CAST(conv_id AS VARCHAR) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, depth, kind, turn, role, call_id, json) AS position,
  turn, role, call_id, CAST(depth AS BIGINT) AS depth, status, errors, sha256(json) AS json_sha256
FROM every
""",
)
def op5_chat_formatting(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    calls, results = tool_turns(conversations)
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("name", "field", "type", "required"), x)]) for x in TOOL_FIELDS]
    schemas = spark.range(1).select(F.inline(F.array(*rows)))
    chats = chat.format_chats(conversations, calls, results, schemas)
    return chats.withColumns({"errors": F.array_join("errors", ","), "json_sha256": digest(F.col("json"))}).drop("json")


@query(
    "op11_mix_sources",
    r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM d GROUP BY source
), t AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS every, coalesce(sum(3 * source_size) OVER ahead, 0) AS spent, coalesce(sum(w) OVER ahead, 0) AS passed
  FROM s WINDOW ahead AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT CAST(total - spent AS DOUBLE) AS words, CAST(every - passed AS DOUBLE) AS rest FROM t WHERE 3 * source_size * (every - passed) >= w * (total - spent) ORDER BY passed LIMIT 1
), b AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), CAST(w AS DOUBLE) * (SELECT words FROM level) / (SELECT rest FROM level)) AS target FROM t
), o AS (
  SELECT d.*, source_size, target, CAST(round_even(target, 0) AS BIGINT) AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || doc_id), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS epochs FROM o)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(whole - epochs * source_size - before, 0), size) AS BIGINT) AS taken FROM e
""",
)
def op11_mix_sources(spark, sf_dir):
    sized = mix.with_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return mix.mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


@query("op12_whiten")
def op12_whiten(spark, sf_dir):
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


@query(
    "op13_spelling_variants",
    r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
), bytes AS (
  SELECT run, k, list_transform(range(length(s) // 2), lambda i: CAST('0x' || substring(s, 2 * i + 1, 2) AS BIGINT)) AS b FROM (SELECT run, k, hex(encode(doc_id || ':' || run)) AS s FROM runs)
), hashed AS (
  SELECT run, k, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, tab
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (
  SELECT word, n, substring(word, 1, i - 1) || substring(word, i + 1) AS rest, i || ':' || substring(word, 1, i - 1) || substring(word, i + 1) AS place
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b USING (place) WHERE a.word <> b.word
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON rest = words.word
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON rest = words.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, list(near ORDER BY n DESC, near)[1] AS near FROM near GROUP BY word
), f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN near END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, form AS last, 1 AS step FROM f WHERE form IS NOT NULL
  UNION ALL
  SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.last WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN roots USING (word)
""",
)
def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))
