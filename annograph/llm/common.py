"""Pieces shared by the text operators: tables, words, row keys and joins on keys that may be hot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from annograph.plans.session import materialize

#: White space of the contracts, and letters that are lower-cased (others keep their case).
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words of letters and digits, and between words of any visible characters.
BETWEEN_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_VISIBLE = r"[\x20\x09-\x0D]+"

#: Rows of one range at most, on average; a sum over ranges then has a row for as many rows of the input.
RANGE_ROWS = 1_000_000
HEAVY_PARTS = 1000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, also where `body` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Text of single bytes takes the built-in, which does the same there and is faster."""
    single = F.octet_length(text) == F.char_length(text)
    return F.when(single, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column, between: str = BETWEEN_ALNUM, lower: bool = True) -> Column:
    """Array of words; empty for null."""
    source = F.coalesce(text, F.lit(""))
    return F.filter(F.split(ascii_lower(source) if lower else source, between), lambda w: w != "")


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`row` (all columns as a struct), `id`, `text` (null as empty) and the row key `k1`, `k2`.

    The key is 128 bits of the id and the text, so rows that repeat an id keep apart unless they are equal, and null
    ids need no special join. Packing the columns keeps names of the caller's from clashing with ours.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.xxhash64(F.col(id_col), text).alias("k1"),
        F.xxhash64(text, F.col(id_col)).alias("k2"),
    )


def unpack(df: DataFrame, replaced: dict[str, Column]) -> DataFrame:
    """The caller's columns in their order, with those in `replaced` replaced or added."""
    names = df.schema["row"].dataType.names
    kept = [(replaced[n] if n in replaced else F.col("row")[n]).alias(n) for n in names]
    return df.select(*kept, *[c.alias(n) for n, c in replaced.items() if n not in names])


def heavy_keys(counts: DataFrame, keys: Sequence[str], weight: str, least: int = 1000) -> list[int]:
    """Hashes of the keys that hold more than a thousandth of all rows: at most `HEAVY_PARTS`, whatever the input's size."""
    total = counts.agg(F.sum(weight)).first()[0] or 0
    found = counts.where(F.col(weight) > max(total / HEAVY_PARTS, least)).select(F.xxhash64(*keys).alias("h"))
    return sorted({r["h"] for r in found.collect()})


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], heavy: list[int], spread: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with the rows of heavy keys spread over `SALTS` tasks by a hash of `spread`, a left column set.

    `right` has few rows a key and is repeated for heavy keys only. `heavy` comes from `heavy_keys` and is short enough
    to stand in the plan.
    """
    if not heavy:
        return left.join(right, list(keys), how)
    is_heavy = F.xxhash64(*keys).isin(heavy)
    salt = F.when(is_heavy, F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a, b = left.withColumn("__salt", salt), right.withColumn("__salt", F.explode(salts))
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """From here on the session hands rows to Python in batches of `most` bytes, unless it does so in smaller ones."""
    if int(spark.conf.get(_BATCH_BYTES).rstrip("bB")) > most:
        spark.conf.set(_BATCH_BYTES, f"{most}b")


#: While a table is written: shuffle files go with their step, Python gets small batches, as texts may be long, and the
#: table is compressed well, since surroundings of neighbouring positions overlap.
_WHILE_STORING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    _BATCH_BYTES: f"{16 << 20}b",
    "spark.sql.parquet.compression.codec": "zstd",
}


def stored(df: DataFrame, label: str) -> DataFrame:
    """`materialize` under the settings above; the caller's settings are put back."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _WHILE_STORING}
    for k, v in _WHILE_STORING.items():
        conf.set(k, v)
    try:
        return materialize(df, label)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def range_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, str], rows: int, label: str) -> DataFrame:
    """`df` with `sums` (new name: column), each the sum over the earlier rows of the group in `order`.

    Rows are range-sorted by group and order, so neither a large group nor a common key is one task's (`order` ends in a
    column that tells rows apart). Each range adds up its own rows; the totals of earlier ranges come from a table with a
    row for each range and group. The ranges are written first, since a range partitioning drawn again may cut elsewhere.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    ranges = stored(df.repartitionByRange(parts, *group, *order).withColumn("__range", F.spark_partition_id()), label)
    cell = ["__range", *group]
    inside = W.partitionBy(*cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    local = ranges.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__in_{n}") for n, c in sums.items()])
    totals = ranges.groupBy(*cell).agg(*[F.sum(c).alias(f"__all_{n}") for n, c in sums.items()])
    offsets = totals.select(*cell, *[F.coalesce(F.sum(f"__all_{n}").over(earlier), F.lit(0)).alias(f"__at_{n}") for n in sums])
    joined = local.join(offsets, cell)
    return joined.select(*df.columns, *[(F.col(f"__in_{n}") + F.col(f"__at_{n}")).alias(n) for n in sums])
