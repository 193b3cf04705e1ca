"""Finding and removing passages of a benchmark in training documents.

A document is scanned as windows of word hashes. The benchmark's windows are broadcast while their number is under a
checked bound; beyond it both sides shuffle on the window hash. Every hash hit is verified word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from annograph.llm.common import let, row_keys, unpack, words_of

WINDOW = 13
#: Benchmark windows that may be broadcast; a window takes some 200 bytes.
BROADCAST_WINDOWS = 200_000


def _window_hashes(words: Column, size: int) -> Column:
    """Hash of each window of `size` words, in order; the array is empty for shorter texts."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (size - 1))
        return F.when(F.size(h) >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, size)))).otherwise(
            F.array().cast("array<bigint>")
        )

    return let(hashes, windows)


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows: `k` words, `gram` text, `h` hash and the `items` that hold it. Short items are one window."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("k", F.least(F.size("words"), F.lit(size)))
    grams = let(
        F.struct("words", "k"),
        lambda x: F.transform(F.sequence(F.lit(1), F.size(x["words"]) - x["k"] + 1), lambda i: F.slice(x["words"], i, x["k"])),
    )
    each = items.select("item", "k", F.explode(F.array_distinct(grams)).alias("g"))
    each = each.select("item", "k", F.array_join("g", " ").alias("gram"), F.xxhash64(F.transform("g", lambda w: F.xxhash64(w))).alias("h"))
    return each.groupBy("k", "h", "gram").agg(F.collect_set("item").alias("items"))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Packed rows of `docs` with `n_words`, `hit` (sorted positions of hit words) and `items` (sorted item ids)."""
    rows = row_keys(docs, id_col, text_col)
    grams = benchmark_windows(benchmark, text_col="text", size=size)
    counts = {r["k"]: r["count"] for r in grams.groupBy("k").count().collect()}  # at most `size` rows
    small = sum(counts.values()) <= broadcast_windows
    scans = []
    for k in sorted(counts):
        known = grams.where(F.col("k") == k).select("h", "gram", "items")
        scan = rows.select("k1", "k2", F.posexplode(_window_hashes(words_of(F.col("text")), k)).alias("pos", "h"))
        found = scan.join(F.broadcast(known) if small else known, "h")
        scans.append(found.select("k1", "k2", F.struct("pos", F.lit(k).alias("k"), "gram", "items").alias("w")))
    if not scans:
        empty = F.array().cast("array<int>")
        return rows.select("row", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), empty.alias("hit"), F.array().cast("array<string>").alias("items"))
    hits = reduce(DataFrame.unionByName, scans).groupBy("k1", "k2").agg(F.collect_set("w").alias("found"))
    joined = rows.join(hits, ["k1", "k2"], "left")

    def verified(x: Column) -> Column:
        same = F.filter(x["found"], lambda w: F.array_join(F.slice(x["words"], w["pos"] + 1, w["k"]), " ") == w["gram"])
        covered = F.flatten(F.transform(same, lambda w: F.sequence(w["pos"], w["pos"] + w["k"] - 1)))
        return F.struct(
            F.size(x["words"]).cast("long").alias("n_words"),
            F.coalesce(F.array_sort(F.array_distinct(covered)), F.array().cast("array<int>")).alias("hit"),
            F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda w: w["items"])))), F.array().cast("array<string>")).alias("items"),
        )

    both = let(F.struct(words_of(F.col("text")).alias("words"), F.col("found")), verified)
    return joined.select("row", "text", both.alias("x")).select("row", "text", "x.*")


def contaminated() -> Column:
    n_hit = F.size("hit")
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def _without_spans(text: Column, hit: Column) -> Column:
    """Words of `text` that no window hit, with what stands before each of them."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    tail = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)

    def rest(x: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(x["pieces"]) - 1), x["hit"])
        return F.concat(F.array_join(F.transform(kept, lambda i: F.get(x["pieces"], i)), ""), x["tail"])

    return let(F.struct(pieces.alias("pieces"), tail.alias("tail"), hit.alias("hit")), rest)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: str = "documents", size: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Mark or remove what a benchmark and `docs` share.

    `remove` is "nothing", "documents" (drops contaminated rows) or "spans" (drops hit words from the text, with what
    stands before them). Returns the columns of `docs` plus `n_words`, `n_hit`, `n_items`, `items` and `contaminated`.

    Words are runs of digits, a-z and characters beyond ASCII, after lower-casing A-Z. A window is `size` consecutive
    words of an item; an item of fewer words is one window, an item without words none. A document is contaminated if
    hit words make a twentieth of it. Null and empty texts have no words and are never contaminated; an empty
    benchmark hits nothing; rows with repeated ids are judged each by its own text; null item ids are left out of
    `items`. Existing columns of the added names are replaced.
    """
    found = find_contamination(docs, benchmark, id_col, text_col, size, broadcast_windows)
    if remove == "documents":
        found = found.where(~contaminated())
    extra = {
        "n_words": F.col("n_words"),
        "n_hit": F.size("hit").cast("long"),
        "n_items": F.size("items").cast("long"),
        "items": F.col("items"),
        "contaminated": contaminated(),
    }
    if remove == "spans":
        extra = {text_col: F.when(F.size("hit") > 0, _without_spans(F.col("row")[text_col], F.col("hit"))).otherwise(F.col("row")[text_col]), **extra}
    return unpack(found, extra)
