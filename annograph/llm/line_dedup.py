"""Removal of lines that many documents share.

Lines are exploded and hashed; only hashes, ids and positions are shuffled, never the line texts. The text of a
document moves once, to meet the list of its dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annograph.llm.common import SPACE, ascii_lower, heavy_keys, let, row_keys, salted_join, stored, unpack


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hashed_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    lines = rows.select("id", "k1", "k2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return keyed.where(F.char_length("key") >= min_chars).select(
        "id", "k1", "k2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def _without(text: Column, dropped: Column) -> Column:
    """`text` without the lines at the positions of `dropped`, in time linear in the lines."""

    def join(x: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["dropped"])
        return F.array_join(F.transform(kept, lambda i: F.get(x["lines"], i)), "\n")

    return let(F.struct(F.split(text, "\n").alias("lines"), dropped.alias("dropped")), join)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop every line whose key stands in at least `min_docs` documents, except in the largest id that holds it.

    The key is the line without outer white space, A-Z lower-cased; keys under `min_chars` code points stay. Returns
    the columns of `docs` with the text replaced, plus `n_lines` (before) and `n_dropped`.

    A null or empty text is one empty line and keeps its value. Rows that repeat an id count as one document. Null ids
    together count as one document, below all others. A document may lose all lines; its text is then empty. Existing
    columns `n_lines` and `n_dropped` are replaced.
    """
    rows = row_keys(docs, id_col, text_col)
    lines = _hashed_lines(rows, min_chars)
    per_doc = lines.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n"))
    shared = per_doc.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"), F.sum("n").alias("n")
    )
    shared = stored(shared.where(F.col("docs") >= min_docs).drop("docs"), "shared-lines")
    heavy = heavy_keys(shared, ["h1", "h2"], "n")
    found = salted_join(lines, shared, ["h1", "h2"], heavy, ["k1", "pos"])
    dropped = (
        found.where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("k1", "k2")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    joined = rows.join(dropped, ["k1", "k2"], "left")
    n_lines = F.size(F.split("text", "\n")).cast("long")
    n_dropped = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    text = F.when(F.col("dropped").isNull(), F.col("row")[text_col]).otherwise(_without(F.col("text"), F.col("dropped")))
    return unpack(joined, {text_col: text, "n_lines": n_lines, "n_dropped": n_dropped})
