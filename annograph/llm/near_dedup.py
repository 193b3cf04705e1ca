"""Near-duplicate documents by probability Jaccard of weighted word shingles.

Signatures come from a Poisson process for each shingle, whose arrivals fall on random registers. A register keeps
its first arrival; a shingle's process ends as soon as its next arrival is later than what every register holds.
Texts that repeat a shingle have a second signature, of the plain set, since links by plain Jaccard need their own bands.
Bands of registers give candidate groups; each group is first compared with one hub, then only what did not reach the
hub's class is compared with the rest of the group. Every link is verified on the whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annograph.llm.common import heavy_keys, row_keys, salted_join, stored, unpack, words_of
from annograph.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Estimated similarity from which a pair is verified: 6 standard deviations of the estimate below the threshold, which
#: a pair of exactly that similarity misses with probability 3e-8. The larger of the two signatures' estimates counts.
ESTIMATE = SIMILARITY - 6 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: Members of a candidate group that are compared inside one task; larger groups are compared block by block.
BLOCK = 4000
#: Words that the members of one task's block have together, unless one text has more.
BLOCK_WORDS = 2_000_000
_CHUNK = 400_000

#: Constants of the splitmix64 mixer.
_STEP, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text's word hashes and their weights, 1 + ln(count). Short texts are one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0)
    size = min(size, len(words))
    n = len(words) - size + 1
    rolled = np.zeros(n, np.uint64)
    for i in range(size):
        rolled = rolled * _MIX2 + words[i : i + n]
    found, counts = np.unique(_mix(rolled + np.uint64(size)), return_counts=True)
    return found, 1 + np.log(counts)


def signatures(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signature of each of `docs` weighted sets; `owner` is the set of each element. Sets must not be empty."""
    first = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, np.uint64)
    at = np.zeros(len(hashes))
    turn = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(hashes):
            turn += np.uint64(1)
            random = _mix(hashes + turn * _STEP)
            at = at - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights
            cell = owner * registers + (_mix(random + _STEP) % np.uint64(registers)).astype(np.int64)
            early = at < first[cell]
            cells, times, marks = cell[early], at[early], hashes[early]
            np.minimum.at(first, cells, times)
            won = times == first[cells]
            winner[cells[won]] = marks[won]
            alive = at < first.reshape(docs, registers).max(axis=1)[owner]
            hashes, weights, owner, at = hashes[alive], weights[alive], owner[alive], at[alive]
    return winner.reshape(docs, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements i of 1 / sum over all j of max(a_j / a_i, b_j / b_i), by one sort of the ratios."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = a[1][ia], b[1][ib]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    upto, after = only_a + np.cumsum(x), only_b + y.sum() - np.cumsum(y)
    return float((1 / (upto / x + after / y)).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of probability Jaccard and plain Jaccard of the shingle sets; they agree where all counts are equal."""
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    union = len(a[0]) + len(b[0]) - common
    return max(probability_jaccard(a, b), common / union) if common else 0.0


def _lists(column: pa.Array) -> list[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    ends = column.offsets.to_numpy()  # of the values before any slicing
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:])]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _lists(batch.column("words"))
        nodes = [hashlib.md5(w.tobytes()).digest() for w in texts]
        keys: list[bytes] = []
        marks: list[bytes] = []
        i = 0
        while i < len(texts):
            j, elements, sets = i, 0, []
            while j < len(texts) and (j == i or elements + len(texts[j]) <= _CHUNK):
                sets.append(shingles(texts[j]))
                elements += len(texts[j])
                j += 1
            repeating = [k for k, (_, weights) in enumerate(sets) if (weights > 1).any()]
            sets += [(sets[k][0], np.ones(len(sets[k][0]))) for k in repeating]
            owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
            made = signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), owner, len(sets))
            buckets = band_keys(made)
            own_keys = [row.tobytes() for row in buckets]
            own_marks = [x.tobytes() + y.tobytes() for x, y in zip(made.astype(np.uint8), buckets.astype(np.uint32))]
            for plain, k in enumerate(repeating, j - i):
                own_keys[k] += own_keys[plain]
                own_marks[k] += own_marks[plain]
            keys += own_keys[: j - i]
            marks += own_marks[: j - i]
            i = j
        yield pa.RecordBatch.from_arrays(
            [batch.column("k1"), batch.column("k2"), batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), *[pa.array(x, pa.binary()) for x in (nodes, keys, marks)]],
            names=["k1", "k2", "id", "size", "node", "keys", "mark"],
        )


def band_keys(signed: np.ndarray) -> np.ndarray:
    """Bucket of each band of each signature."""
    sigs = signed.astype(np.uint32).reshape(-1, BANDS, ROWS)
    keys = np.zeros((len(sigs), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = _mix(keys * _MIX2 + sigs[:, :, i])
    return keys


def _twice(column: pa.Array, size: int) -> np.ndarray:
    """Bytes of the weighted and of the plain signature of each row; rows that hold `size` bytes have the same for both."""
    return np.frombuffer(b"".join([x if len(x) > size else x * 2 for x in column.to_pylist()]), np.uint8).reshape(-1, 2, size)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both signatures use the same buckets; a row stands in a bucket once."""
    for batch in batches:
        keys = _twice(batch.column("keys"), 8 * BANDS).view(np.int64)
        wanted = np.ones(keys.shape, bool)
        wanted[:, 1] = keys[:, 1] != keys[:, 0]
        row, _, band = np.nonzero(wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[wanted]), pa.array(band.astype(np.int32)), batch.column("node").take(pa.array(row))], names=["bucket", "band", "node"]
        )


def _marks(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte of each register, enough to estimate similarity from, and 32 bits of each band's bucket, of both signatures."""
    data = _twice(column, REGISTERS + 4 * BANDS)
    return np.ascontiguousarray(data[:, :, :REGISTERS]), np.ascontiguousarray(data[:, :, REGISTERS:]).view(np.uint32)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=2).max(axis=1) >= ESTIMATE


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = _near(_marks(batch.column("mark_u"))[0], _marks(batch.column("mark_v"))[0])
        yield batch.select(["u", "v"]).filter(pa.array(near))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: dict[bytes, tuple] = {}

    def of(node: bytes, words: np.ndarray) -> tuple:
        if node not in last:
            if len(last) >= 64:
                last.clear()
            last[node] = shingles(words)
        return last[node]

    for batch in batches:
        us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
        a, b = _lists(batch.column("words_u")), _lists(batch.column("words_v"))
        good = [similarity(of(u, x), of(v, y)) >= SIMILARITY for u, v, x, y in zip(us, vs, a, b)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([u for u, g in zip(us, good) if g], pa.binary()), pa.array([v for v, g in zip(vs, good) if g], pa.binary())],
            names=["u", "v"],
        )


def _compared(cell: np.ndarray, band: np.ndarray, label: np.ndarray, open_: np.ndarray, marks: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell, in different classes, at least one `open_`, that look similar enough to verify.

    A pair that shares several buckets comes from those of the first band only. Small cells are compared together, one distance
    in the sorted rows at a time; a large one on its own, a row at a time.
    """

    registers, keys = marks

    def passing(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (label[i] != label[j]) & (open_[i] | open_[j])
        i, j = i[ok], j[ok]
        near = _near(registers[i], registers[j])
        i, j = i[near], j[near]
        a, b = keys[i], keys[j]
        first = ((a == b) | (a == b[:, ::-1])).any(axis=1).argmax(axis=1)
        keep = first == band[i]
        return i[keep], j[keep]

    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    rows, small, end = np.arange(len(cell)), np.repeat(sizes <= 64, sizes), np.repeat(starts + sizes, sizes)
    for lag in range(1, 64):
        i = rows[small & (rows + lag < end)]
        if not len(i):
            break
        for part in np.array_split(i, len(i) // 100_000 + 1):
            yield passing(part, part + lag)
    for start, size in zip(starts[sizes > 64], sizes[sizes > 64]):
        members = np.arange(start, start + size)
        for i in members[open_[members]]:
            others = members[(members > i) | ~open_[members]]
            yield passing(np.full(len(others), i), others)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole cells of rows that arrive sorted by cell; only the last, unfinished one is held besides the batch."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if len(held):
            cells = held.column("cell").to_numpy()
            open_from = int(np.argmax(cells == cells[-1]))
            if open_from:
                yield held.slice(0, open_from).combine_chunks()
                held = held.slice(open_from)
    if held is not None and len(held):
        yield held.combine_chunks()


def _candidates(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cell = np.unique(t.column("cell").to_numpy(), return_inverse=True)[1]
    label = np.unique(np.array(t.column("label").to_pylist(), dtype="S16"), return_inverse=True)[1]
    return _compared(cell, t.column("band").to_numpy(), label, t.column("open").to_numpy(), _marks(t.column("mark")))


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell that are part of any pair worth verifying."""
    for t in _cells(batches):
        wanted = np.zeros(len(t), bool)
        for i, j in _candidates(t):
            wanted[i] = wanted[j] = True
        yield from t.filter(pa.array(wanted)).to_batches()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verifies the pairs of each cell where its rows are and returns the links that join classes: fewer than rows."""
    for t in _cells(batches):
        node, label = t.column("node").to_pylist(), t.column("label").to_pylist()
        words = _lists(_flat(t.column("words")))
        made: dict[int, tuple] = {}
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def of(row: int) -> tuple:
            if row not in made:
                made[row] = shingles(words[row])
            return made[row]

        us, vs = [], []
        for i, j in _candidates(t):
            for a, b in zip(i.tolist(), j.tolist()):
                left, right = root(label[a]), root(label[b])
                if left != right and similarity(of(a), of(b)) >= SIMILARITY:
                    parent[left] = right
                    us.append(node[a])
                    vs.append(node[b])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


_LINK = "u binary, v binary"


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs that are similar on their whole shingle sets. A hub's words go to several tasks, not its pairs to one."""
    counts = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(counts, ["v"], "n")
    first = pairs.join(words.select(F.col("node").alias("u"), F.col("words").alias("words_u")), "u")
    both = salted_join(first, words.select(F.col("node").alias("v"), F.col("words").alias("words_v")), ["v"], heavy, ["u"])
    return both.select("u", "v", "words_u", "words_v").mapInArrow(_verify, _LINK)


def _links(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Verified links between texts of different word sequences, enough of them to connect each class."""
    nodes = signed.select("node", "keys", "mark", "size").dropDuplicates(["node"])
    entries = nodes.select("node", "keys").mapInArrow(_bands, "bucket bigint, band int, node binary")
    counts = stored(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    heavy = heavy_keys(counts, ["bucket"], "n")
    members = stored(
        salted_join(entries, counts, ["bucket"], heavy, ["node"]).join(nodes.select("node", "mark", "size"), "node"), "members"
    )
    chosen = members.groupBy("node").agg(F.sum("n").alias("reach"))
    texts = signed.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k")).join(chosen, "node").select("node", "k.k1", "k.k2")
    words = stored(rows.join(texts, ["k1", "k2"]).dropDuplicates(["node"]).select("node", _hashed_words().alias("words")), "words")
    # The member that shares the most groups with others is the one that most members are likely to resemble.
    hubs = stored(
        members.join(chosen, "node").groupBy("bucket").agg(F.max(F.struct("reach", "node", "mark")).alias("hub")).select("bucket", "hub.node", "hub.mark"), "hubs"
    )
    renamed = hubs.select("bucket", F.col("node").alias("v"), F.col("mark").alias("mark_v"))
    stars = salted_join(members.select("bucket", F.col("node").alias("u"), F.col("mark").alias("mark_u")), renamed, ["bucket"], heavy, ["u"])
    stars = stars.where("u != v").select("u", "v", "mark_u", "mark_v").mapInArrow(_promising, _LINK).distinct()
    first = stored(_verified(stars, words), "star-links")
    labels = stored(components(first), "classes")
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    hub_label = hubs.join(labels, "node", "left").select("bucket", F.coalesce("label", "node").alias("hub_label"))
    placed = salted_join(labelled, hub_label, ["bucket"], heavy, ["node"]).withColumn("open", F.col("label") != F.col("hub_label"))
    placed = stored(placed.drop("hub_label"), "placed")
    unfinished = placed.groupBy("bucket").agg(F.max("open").alias("open"), F.sum("size").alias("words")).where("open").select("bucket", "words")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.xxhash64("bucket", F.least(i, own), F.greatest(i, own)))
    spread = salted_join(placed, unfinished, ["bucket"], heavy, ["node"]).withColumn("cell", F.explode(cells))
    near = spread.select("cell", "band", "node", "mark", "label", "open").repartition("cell").sortWithinPartitions("cell")
    near = near.mapInArrow(_involved, "cell bigint, band int, node binary, mark binary, label binary, open boolean")
    near = near.join(words, "node").select("cell", "band", "node", "mark", "label", "open", "words").repartition("cell").sortWithinPartitions("cell")
    second = near.mapInArrow(_settle, _LINK)
    return first.unionByName(second)


def _hashed_words():
    return F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of `docs` with `k1`, `k2`, `class_id` (smallest id of the class), `class_size` and `kept`.

    Two texts are linked if the probability Jaccard of their five-word shingles, weighted 1 + ln(count), or the plain
    Jaccard of the shingle sets is 0.8 or more; a class is what links connect. Words are runs of digits, a-z and
    characters beyond ASCII after lower-casing A-Z; equal word sequences are always linked. A text of fewer than five
    words is one shingle. Texts without words, null and empty ones included, are each a class of their own. `kept` is
    true for the row with the smallest id of its class (null ids first; equal rows are all marked); rows with repeated
    ids are judged each by its own text.
    """
    rows = row_keys(docs, id_col, text_col)
    hashed = rows.select("k1", "k2", "id", _hashed_words().alias("words")).where(F.size("words") > 0)
    kind = dict(rows.dtypes)["id"]
    signed = stored(hashed.mapInArrow(_sign, f"k1 bigint, k2 bigint, id {kind}, size bigint, node binary, keys binary, mark binary"), "signatures")
    classes = stored(components(_links(rows, signed)), "classes")
    labelled = signed.select("k1", "k2", "id", "node").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "k1", "k2")).alias("first"))
    heavy = heavy_keys(first, ["label"], "n")
    marked = salted_join(labelled, first.select("label", "n", "first"), ["label"], heavy, ["k1"]).select(
        "k1", "k2", F.col("first.id").alias("class_id"), F.col("n").alias("class_size"),
        ((F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))).alias("kept"),
    )
    joined = rows.drop("text").join(marked.dropDuplicates(["k1", "k2"]), ["k1", "k2"], "left")
    return joined.select(
        "row", "k1", "k2",
        F.when(F.col("kept").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
    )


def assign_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of `docs` plus `class_id`, `class_size` and `kept`; see `near_duplicates`. Existing columns of these
    names are replaced."""
    found = near_duplicates(docs, id_col, text_col)
    return unpack(found, {c: F.col(c) for c in ("class_id", "class_size", "kept")})


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near duplicates, the one with the smallest id; of equal rows just one. Texts without
    words all stay."""
    found = near_duplicates(docs, id_col, text_col).where("kept")
    worded = F.size(words_of(F.col("row")[text_col])) > 0
    once = found.where(worded).dropDuplicates(["k1", "k2"]).unionByName(found.where(~worded))
    return unpack(once, {})
