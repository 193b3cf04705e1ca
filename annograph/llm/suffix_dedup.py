"""Removal of byte strings that occur more than once anywhere in the corpus.

Blockwise suffix sorting with a cover sample: suffixes are not all sorted. A sample of positions covers the text so that
two equal strings of `LENGTH` bytes, wherever they start, both hold a sample position at the same distance from their
starts. The sample is chosen by content (the smallest hash of a short gram in each string) rather than by position
modulo a period, which has the same covering property with a tenth of the positions; see the README.

Sample suffixes get ranks first: equal surroundings of a sample position are one rank, found by counting hashes. Only
where a rank stands alone although its gram does not, bytes are compared: such surroundings are dealt into buckets by
what a common string needs to share on the right or on the left, and one bucket at a time is sorted in memory, for each
distance of a string's start. Buckets too large for that are counted by Spark instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from annograph.llm.common import heavy_keys, row_keys, salted_join, stored, unpack

LENGTH = 200
GRAM = 32
#: Starts of a string that can hold a given sample position, less one; also the reach to the left of the position.
REACH = LENGTH - GRAM
#: A common string shares LENGTH - SPLIT bytes from the sample position on, or SPLIT bytes before it and the gram.
SPLIT = 84
SEGMENT = 2_000_000
MARGIN = 3 * LENGTH
#: Rows of a bucket that are sorted in one task, some 100 MB; larger buckets are counted by Spark.
BUCKET_ROWS = 100_000
BLOCK_ROWS = 5_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_CODES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self, base: int, size: int) -> None:
        self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)])
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(base, -1, 2**64), np.uint64)])

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums from which the hash of any substring follows."""
        return np.r_[np.uint64(0), np.cumsum(_CODES[data] * self.up[: len(data)])]

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """`op` (minimum or maximum) over each full window."""
    done = 1
    while done * 2 <= width:
        values = op(values[:-done], values[done:])
        done *= 2
    return op(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def sample_positions(data: np.ndarray, room: np.ndarray, gram_hash: np.ndarray) -> np.ndarray:
    """Positions whose gram hash is the smallest of some string of `LENGTH` bytes; `room` is what a text has from each
    position on. All positions of a tie are taken, so the choice depends on the string's content only."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64)
    short = (_mix(gram_hash) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    smallest = _sliding(short, REACH + 1, np.minimum)
    smallest = np.where(room[: len(smallest)] >= LENGTH, smallest, np.uint32(0))
    around = np.concatenate([np.zeros(REACH, np.uint32), smallest, np.zeros(REACH, np.uint32)])
    return np.flatnonzero(_sliding(around, REACH + 1, np.maximum)[: len(short)] == short)


def _segments(texts: list[bytes]) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(text number, offset, bytes, first and last core position): long texts in overlapping parts."""
    for number, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for core in range(0, len(text), SEGMENT):
            begin, end = max(0, core - MARGIN), min(len(text), core + SEGMENT + MARGIN)
            yield number, begin, text[begin:end], core - begin, min(core + SEGMENT, len(text)) - begin


def _sampled(parts: list[tuple[int, int, bytes, int, int]], powers: list[Powers]) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    ends = np.cumsum(sizes)
    part = np.repeat(np.arange(len(parts)), sizes)
    room = ends[part] - np.arange(len(data))
    one, two = (p.sums(data) for p in powers)
    last = len(data) - GRAM + 1
    gram = (one[GRAM:] - one[:-GRAM]) * powers[0].down[:last]
    at = sample_positions(data, room, gram)
    begin, own = (ends - sizes)[part[at]], at - (ends - sizes)[part[at]]
    core = np.array([(p[3], p[4]) for p in parts])[part[at]]
    keep = (own >= core[:, 0]) & (own < core[:, 1])
    at, begin, own = at[keep], begin[keep], own[keep]
    left, right = np.maximum(begin, at - REACH), np.minimum(ends[part[at]], at + LENGTH)
    shape = _mix((at - left).astype(np.uint64) * np.uint64(1024) + (right - at).astype(np.uint64))
    number = np.array([p[0] for p in parts])[part[at]]
    offset = np.array([p[1] for p in parts])[part[at]]
    return [number, own + offset, _mix(gram[at]), _mix(powers[0].hashes(one, left, right) + shape), _mix(powers[1].hashes(two, left, right) + shape)]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers: list[Powers] = []
    with np.errstate(over="ignore"):
        for batch in batches:
            texts = batch.column("data").to_pylist()
            parts: list = []
            size = 0
            for part in [*_segments(texts), None]:
                if parts and (part is None or size + len(part[2]) > SEGMENT + 2 * MARGIN):
                    powers = powers or [Powers(b, SEGMENT + 2 * MARGIN) for b in _BASES]
                    number, at, *hashes = _sampled(parts, powers)
                    rows = pa.array(number)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array(at), *[pa.array(h.view(np.int64)) for h in hashes]],
                        names=["k1", "k2", "pos", "gram", "c1", "c2"],
                    )
                    parts, size = [], 0
                if part is not None:
                    parts.append(part)
                    size += len(part[2])


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings of the listed positions, once for the bucket of each side that is long enough."""
    names = ["bucket", "c1", "c2", "alone", "left", "bytes"]
    with np.errstate(over="ignore"):
        powers = Powers(_BASES[0], REACH + LENGTH + 1)
        for batch in batches:
            rows: list[tuple] = []
            for text, wanted in zip(batch.column("data").to_pylist(), batch.column("wanted").to_pylist()):
                for w in wanted:
                    at = w["pos"]
                    left = min(REACH, at)
                    around = text[at - left : at + LENGTH]
                    rows.append((left, around, w["c1"], w["c2"], w["alone"]))
            for i in range(0, len(rows), 20_000):
                some = rows[i : i + 20_000]
                out = []
                for side, (a, b) in enumerate(((0, LENGTH - SPLIT), (-SPLIT, GRAM))):
                    fits = [r for r in some if r[0] + a >= 0 and r[0] + b <= len(r[1])]
                    if not fits:
                        continue
                    held = np.frombuffer(b"".join(r[1][r[0] + a : r[0] + b] for r in fits), np.uint8).reshape(len(fits), b - a)
                    keys = _mix((_CODES[held] * powers.up[: b - a]).sum(axis=1, dtype=np.uint64) + np.uint64(side + 1))
                    out += [(k, r[2], r[3], r[4], r[0], r[1]) for k, r in zip(keys.view(np.int64).tolist(), fits)]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _strings(bucket: np.ndarray, left: np.ndarray, around: list[bytes], powers: Powers) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance 0..REACH of a string's start before the sample position: the rows that have such a string, and
    its hashes with the bucket mixed in. The hash rolls one byte to the left from distance to distance."""
    data = np.zeros((REACH + LENGTH, len(around)), np.uint8)
    for row, (n, text) in enumerate(zip(left.tolist(), around)):
        data[REACH - n : REACH - n + len(text), row] = np.frombuffer(text, np.uint8)
    right = np.array([len(t) for t in around], np.int64) - left
    salt = _mix(bucket.view(np.uint64))
    rolled = np.zeros(len(around), np.uint64)
    for column in range(REACH, REACH + LENGTH):
        rolled = rolled * powers.up[1] + _CODES[data[column]]
    for distance in range(REACH + 1):
        if distance:
            first, gone = REACH - distance, REACH - distance + LENGTH
            rolled = (rolled - _CODES[data[gone]]) * powers.down[1] + _CODES[data[first]] * powers.up[LENGTH - 1]
        rows = np.flatnonzero((distance <= left) & (right >= LENGTH - distance))
        yield distance, rows, _mix(rolled[rows] + salt[rows])


def _sorted_block(bucket: np.ndarray, left: np.ndarray, around: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance at which a row's string stands in another row of its bucket; -1 if none does."""
    low, high = np.full(len(around), -1), np.full(len(around), -1)
    for distance, rows, hashes in _strings(bucket, left, around, powers):
        order = np.argsort(hashes)
        equal = hashes[order[1:]] == hashes[order[:-1]]
        twice = rows[order[np.r_[equal, False] | np.r_[False, equal]]] if len(rows) else rows
        low[twice] = np.where(low[twice] < 0, distance, low[twice])
        high[twice] = distance
    return low, high


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket; whole buckets are put together into blocks of some `BLOCK_ROWS` rows."""
    powers = Powers(_BASES[1], REACH + LENGTH + 1)

    def solve(t: pa.Table) -> list[pa.RecordBatch]:
        t = t.combine_chunks()
        bucket = t.column("bucket").to_numpy()
        near = np.r_[bucket[1:] == bucket[:-1], False] | np.r_[False, bucket[1:] == bucket[:-1]]
        t = t.filter(pa.array(near))
        lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        bucket, left = t.column("bucket").to_numpy(), t.column("left").to_numpy()
        begin = 0
        edges = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1 if len(bucket) else []
        for end in edges:
            if end - begin >= BLOCK_ROWS or end == len(bucket):
                low, high = _sorted_block(bucket[begin:end], left[begin:end], t.column("bytes").slice(begin, end - begin).to_pylist(), powers)
                lows.append(low)
                highs.append(high)
                begin = end
        low, high = np.concatenate(lows), np.concatenate(highs)
        keep = pa.array((low >= 0) & t.column("alone").to_numpy(zero_copy_only=False).astype(bool)) if len(bucket) else pa.array([], pa.bool_())
        made = pa.table({"c1": t.column("c1"), "c2": t.column("c2"), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})
        return made.filter(keep).combine_chunks().to_batches()

    with np.errstate(over="ignore"):
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) < BLOCK_ROWS:
                continue
            bucket = held.column("bucket").to_numpy()
            open_from = int(np.argmax(bucket == bucket[-1]))
            if open_from:
                yield from solve(held.slice(0, open_from))
                held = held.slice(open_from)
        if held is not None and len(held):
            yield from solve(held)


def _list_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each string of each row of a large bucket."""
    powers = Powers(_BASES[1], REACH + LENGTH + 1)
    with np.errstate(over="ignore"):
        for batch in batches:
            for i in range(0, len(batch), BLOCK_ROWS):
                some = batch.slice(i, BLOCK_ROWS)
                for distance, rows, hashes in _strings(some.column("bucket").to_numpy(), some.column("left").to_numpy(), some.column("bytes").to_pylist(), powers):
                    here = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes.view(np.int64)), pa.array(np.full(len(rows), distance)), *[some.column(c).take(here) for c in ("c1", "c2", "alone")]],
                        names=["h", "distance", "c1", "c2", "alone"],
                    )


def _large_buckets(rows: DataFrame) -> DataFrame:
    strings = rows.mapInArrow(_list_strings, "h bigint, distance bigint, c1 bigint, c2 bigint, alone boolean")
    counts = stored(strings.groupBy("h", "distance").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "strings")
    found = salted_join(strings.where("alone"), counts, ["h", "distance"], heavy_keys(counts, ["h", "distance"], "n"), ["c1"])
    return found.groupBy("c1", "c2").agg(F.min("distance").alias("low"), F.max("distance").alias("high")).select("c1", "c2", "low", "high")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """`k1`, `k2`, `begin`, `end` of spans that cover every byte to remove; spans may overlap and reach past the end."""
    data = rows.select("k1", "k2", F.col("text").cast("binary").alias("data"))
    sample = stored(data.mapInArrow(_sample, "k1 bigint, k2 bigint, pos bigint, gram bigint, c1 bigint, c2 bigint"), "sample")
    grams = sample.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("c1") != F.max("c1")).alias("mixed"))
    grams = stored(grams.where("n > 1"), "grams")
    heavy = heavy_keys(grams, ["gram"], "n")
    again = stored(salted_join(sample, grams.drop("n"), ["gram"], heavy, ["k1", "pos"]), "repeated-grams")
    ranks = again.where("mixed").groupBy("gram", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("at"))
    ranks = stored(ranks, "ranks")
    shared = ranks.where("n > 1").select("c1", "c2", "n")
    inner = again.where("mixed").select("k1", "k2", "pos", "c1", "c2")
    inner = salted_join(inner, shared, ["c1", "c2"], heavy_keys(shared, ["c1", "c2"], "n"), ["k1", "pos"]).select("k1", "k2", "pos")
    inner = inner.unionByName(again.where("not mixed").select("k1", "k2", "pos"))
    whole = inner.select("k1", "k2", F.greatest(F.lit(0), F.col("pos") - REACH).alias("begin"), (F.col("pos") + LENGTH).alias("end"))

    lone = ranks.groupBy("gram").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("n")).where("least = 1")
    open_ = salted_join(ranks.withColumnRenamed("n", "count"), lone.select("gram"), ["gram"], heavy_keys(lone, ["gram"], "n"), ["c1"])
    wanted = open_.select("at.k1", "at.k2", F.struct("at.pos", "c1", "c2", (F.col("count") == 1).alias("alone")).alias("w"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_set("w").alias("wanted"))
    texts = data.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    around = texts.select("data", "wanted").mapInArrow(_bucketed, "bucket bigint, c1 bigint, c2 bigint, alone boolean, left int, bytes binary")
    around = stored(around, "surroundings")
    sizes = stored(around.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("alone")).where("n > 1 and alone").select("bucket", "n"), "bucket-sizes")
    usual = around.join(sizes.where(F.col("n") <= BUCKET_ROWS).select("bucket"), "bucket")
    reach = usual.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets, "c1 bigint, c2 bigint, low bigint, high bigint")
    big = sizes.where(F.col("n") > BUCKET_ROWS)
    if big.take(1):
        heavy_buckets = heavy_keys(sizes, ["bucket"], "n", BUCKET_ROWS)
        reach = reach.unionByName(_large_buckets(salted_join(around, big, ["bucket"], heavy_buckets, ["c1"]).select(*around.columns)))
    reach = reach.groupBy("c1", "c2").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    lonely = ranks.where("n = 1").select("c1", "c2", "at.k1", "at.k2", "at.pos")
    edge = lonely.join(reach, ["c1", "c2"]).select("k1", "k2", (F.col("pos") - F.col("high")).alias("begin"), (F.col("pos") + LENGTH - F.col("low")).alias("end"))
    return stored(whole.unionByName(edge), "spans")


def _cut(data: Column, spans: Column) -> Column:
    @F.arrow_udf("struct<kept binary, removed bigint, spans bigint>")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        kept, removed, runs = [], [], []
        for text, own in zip(texts.to_pylist(), found.to_pylist()):
            at, parts, lost, count = 0, [], 0, 0
            reached = -1
            for span in sorted((s["begin"], min(s["end"], len(text))) for s in own or ()):
                if span[0] > reached:
                    count += 1
                if span[1] > reached:
                    begin = max(span[0], reached, 0)
                    parts.append(text[at:begin])
                    lost += span[1] - begin
                    at = reached = span[1]
            parts.append(text[at:])
            kept.append(b"".join(parts) if count else text)
            removed.append(lost)
            runs.append(count)
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=["kept", "removed", "spans"])

    return cut(data, spans)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a string of 200 bytes that also starts anywhere else in `docs`.

    Returns the columns of `docs` plus `kept` (the remaining UTF-8 bytes; cuts may fall inside a character, so it is
    binary), `n_bytes`, `n_removed` and `n_spans`. Strings are judged on the input and never cross documents; all their
    occurrences go. Null and empty texts have no bytes; texts under 200 bytes stay whole; equal rows are each other's
    repeats. Existing columns of the added names are replaced.
    """
    rows = row_keys(docs, id_col, text_col)
    spans = repeated_spans(rows).groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("found"))
    joined = rows.join(spans, ["k1", "k2"], "left").withColumn("data", F.col("text").cast("binary"))
    cut = joined.select("row", "data", _cut(F.col("data"), F.col("found")).alias("x"))
    return unpack(cut, {
        "kept": F.col("x.kept"), "n_bytes": F.octet_length("data").cast("long"), "n_removed": F.col("x.removed"), "n_spans": F.col("x.spans"),
    })
