"""Mixing sources to target weights: random order within each source, prefix sums of words, a cut at each budget.

Sources stand in code-point order, null last, and take the weights in turn. Together they share as many words as all
documents hold. A target never exceeds three times its source; what is above goes to the others by weight, which makes
every target `min(3 * size, level * weight)` for one level. A source whose target is e full rounds and a rest gives
every document e times, and the documents in front of the cut once more; the document at the cut gives only the words
up to it. So the words taken of a source are its target, rounded to a whole word.

Defined results: a null or empty text has no words and takes none; sources without words get the target 0; rows that
repeat an id are documents of their own (equal rows are interchangeable); an empty table gives an empty one. Added
columns replace the caller's of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType, VariantType

from annograph.llm.common import BETWEEN_VISIBLE, SPACE, range_sums, stored

WEIGHTS = (1, 2, 3)
MOST_ROUNDS = 3
SEED = "mix"
ADDED = ("source_size", "target", "epochs", "part", "taken")


def word_count(text: Column) -> Column:
    """Number of words between white space, long; 0 for null."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", 0).otherwise(F.coalesce(F.size(F.split(inner, BETWEEN_VISIBLE)), F.lit(0))).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_ROUNDS) -> DataFrame:
    """(unnamed, name, source_size) of every source in, the same with `target` out.

    Sources in the order of `most * size / weight` fill up first. With C words and weight W in front of a source, the
    level would be (T - C) / (all - W) if this and all later sources stay below their bound; the first source for which
    that holds sets the level.
    """
    n, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    ranked = range_sums(sizes.withColumn("__one", F.lit(1)), [], ["unnamed", "name"], {"__place": "__one"}, n, "sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    bound = F.col("source_size") * most
    weighed = ranked.withColumn("__weight", weight.cast("bigint")).withColumn("__bound", bound).withColumn("__full", bound / F.col("__weight"))
    filled = range_sums(weighed, [], ["__full", "unnamed", "name"], {"__spent": "__bound", "__passed": "__weight"}, n, "sources")
    every = F.lit(filled.agg(F.coalesce(F.sum("__weight"), F.lit(0))).first()[0])
    wide = lambda c: c.cast("decimal(19,0)")
    left, rest = F.lit(total) - F.col("__spent"), every - F.col("__passed")
    below = wide(F.col("__bound")) * wide(rest) >= wide(F.col("__weight")) * wide(left)
    level = filled.where(below).agg(F.min_by(F.struct(left.alias("words"), rest.alias("weight")), F.struct("__full", "unnamed", "name")).alias("l")).first()["l"]
    words, weight_left = (level["words"], level["weight"]) if level else (0, 1)
    share = F.col("__weight").cast("double") * F.lit(float(words)) / F.lit(float(weight_left))
    return filled.select(*sizes.columns, F.least(F.col("__bound").cast("double"), share).alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
    weights: Sequence[int] = WEIGHTS, most: int = MOST_ROUNDS, seed: str = SEED,
) -> DataFrame:
    """The caller's columns with `source_size`, `target`, `epochs` (whole copies), `part` (words of one more, cut copy)
    and `taken` = epochs * size + part.

    The order is the MD5 of seed and id, so runs agree. Rows with the same id stand by size and content; rows equal in
    all of these take any order, as they cannot be told apart.
    """
    hashable = [c.name for c in docs.schema if not isinstance(c.dataType, (MapType, VariantType))]
    rows = docs.select(
        F.struct("*").alias("row"), F.col(source_col).isNull().alias("unnamed"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("key"),
        F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)).alias("words"), F.xxhash64(*hashable).alias("content"), F.monotonically_increasing_id().alias("tie"),
    )
    rows = stored(rows, "sizes")
    source = ["unnamed", "name"]
    sizes = stored(rows.groupBy(*source).agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    budgets = stored(targets(sizes.drop("n"), weights, most), "targets")
    placed = range_sums(rows, source, ["key", "words", "content", "tie"], {"before": "words"}, n, "order")
    whole = F.rint("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("bigint")
    cut = whole - epochs * F.col("source_size")
    reach = F.least(F.greatest(cut - F.col("before"), F.lit(0)), F.col("words"))
    done = placed.join(budgets, source).select("row", "words", "source_size", "target", epochs.alias("e"), reach.alias("r"))
    full = (F.col("r") == F.col("words")) & (F.col("words") > 0)
    added = {
        "source_size": F.col("source_size"), "target": F.col("target"), "epochs": F.col("e") + full.cast("bigint"),
        "part": F.when(full, F.lit(0)).otherwise(F.col("r")).cast("bigint"), "taken": F.col("e") * F.col("words") + F.col("r"),
    }
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED]
    return done.select(*kept, *[c.alias(n) for n, c in added.items()])


def with_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("size", word_count(F.col(text_col)))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, for 0 < n below its number of words."""
    lead = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    behind = F.element_at(F.split(lead, BETWEEN_VISIBLE, (n + 1).cast("int")), -1)
    upto = F.substring(text, F.lit(1), F.char_length(text) - F.char_length(behind))
    return F.regexp_replace(upto, r"[\x20\x09-\x0D]+\z", "")


def copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: a row for each copy of each row of `mix_sources`, with `copy` from 1; a cut copy has the first `part` words."""
    n = (F.col("epochs") + (F.col("part") > 0).cast("bigint")).cast("int")
    rows = mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), n)))
    text = F.when(F.col("copy") > F.col("epochs"), first_words(F.col(text_col), F.col("part"))).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text)
