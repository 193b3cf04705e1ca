"""Spelling variants: words one edit apart, found by scanning sorted vocabularies with edit-matrix rows.

A list of words is sorted, and the common prefixes of neighbouring words cut it into ranges: for every depth, a range of
words that agree so far. The scan goes down the depths. A row of the edit matrix is worked out once for a range and
a query, from the row of the range around it, and serves all words of the range; a range whose row exceeds one edit is
skipped for that query. Rows are banded: two cells, the diagonal and the one beside it, as no other cell leads to one
edit where the scanned word is as long as the query or one longer.

Spark deals out the lists. One edit leaves the first or the last half of a word as it is, so words meet in lists of
those that share the first or the last `length // 2` letters, lists of words ending alike being sorted from behind. A
list of over `LIST_CHARS` letters is split again by the same argument on what its words don't share, until lists are
short or just one letter is open. No list is cut and no candidate dropped; the bound on the common prefix (`within`)
lets a pair come from one list only.

Defined results: null and empty texts have no words; a null id is empty in the text that is hashed; rows that repeat an
id count as often as they stand there; an empty table gives an empty one; columns other than id and text are ignored.
Runs of letters of any length are words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annograph.llm.common import UPPER, heavy_keys, salted_join, stored

#: The letters of words, the divisor that marks a slip, the shortest word and the fewest occurrences. All
#: letters are in Latin-1, so a text is read as bytes of it, where every other character becomes one that is no letter.
LETTERS = b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0xC0, 0x100))
SLIP, SHORTEST, FEWEST = 97, 5, 3
FACTOR = 2
#: Letters of one list at most, unless only one letter of its words is open.
LIST_CHARS = 1_000_000
#: Cells of the letter table of one scan, rows of the matrix held at once, and words counted before they are handed on.
SCAN_CELLS, SCAN_ROWS, COUNTED = 4_000_000, 2_000_000, 500_000
#: Bytes of a text split into words at once.
PIECE = 1 << 20

_UPPER = UPPER.encode()
_READ = bytes(c if c in LETTERS else c + 32 if c in _UPPER else 32 for c in range(256))


def _runs(text: str) -> Iterator[list[bytes]]:
    """All runs of letters of a text, lower-cased, some at a time."""
    data = text.encode("latin-1", "replace").translate(_READ)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + PIECE)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def _hashes(runs: list[bytes], start: int) -> list[int]:
    """crc32 of the runs as UTF-8, each going on from `start`."""
    return [zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), start) for r in runs]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = SLIP, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n) of all words long and frequent enough.

    A run loses the letter at h % length where `slip` divides h, the crc32 of `<id>:<run>`; None leaves all runs whole.
    """

    def count(batches):
        counted: Counter[bytes] = Counter()

        def out():
            words = pa.array([w.decode("latin-1") for w in counted], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counted.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{i.as_py() or ''}:".encode())
                for runs in _runs(text.as_py()):
                    runs = [r for r in runs if len(r) >= shortest]
                    counted.update(runs)
                    for run, h in zip(runs, _hashes(runs, start)) if slip else ():
                        if h % slip == 0:
                            at = h % len(run)
                            counted[run] -= 1
                            if len(run) > shortest:
                                counted[run[:at] + run[at + 1 :]] += 1
                    if len(counted) > COUNTED:
                        yield out()
                        counted.clear()
        yield out()

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    words = texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where(F.col("n") >= fewest)


# ---------------------------------------------------------------- the scan of sorted lists


def _letters(words: Sequence[str], width: int) -> np.ndarray:
    """Code points, a row for each word, filled up with zeros."""
    return np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le"), np.uint32).reshape(len(words), width)


def scan(lists: Sequence[Sequence[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, word), as places in the lists set end to end, of words one edit apart, where the word is as long as the query or
    one letter longer. Every list is sorted without repeats, and its shortest words are its queries. Two words of a length come
    twice, once in each role.
    """
    words = [w for one in lists for w in one]
    length = np.array([len(w) for w in words], np.int64)
    width = int(length.max())
    letters = _letters(words, width + 1)
    first = np.cumsum([0, *[len(one) for one in lists]])
    common = np.zeros(len(words), np.int64)  # letters shared with the word in front; -1 where a list begins
    if len(words) > 1:
        differ = letters[1:] != letters[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), width)
    common[first[:-1]] = -1
    list_of = np.repeat(np.arange(len(lists)), np.diff(first))
    query = np.flatnonzero(length == np.minimum.reduceat(length, first[:-1])[list_of])
    zero = np.zeros(len(query), np.uint8)
    waiting = [(0, query, first[list_of[query]], first[list_of[query] + 1], zero, zero + 2)]
    starts = {}
    while waiting:
        depth, query, begin, end, same, longer = waiting.pop()
        if depth not in starts:
            bounds = np.flatnonzero(common <= depth)
            starts[depth] = bounds[length[bounds] > depth], np.append(bounds, len(words))
        inner, bounds = starts[depth]
        low = np.searchsorted(inner, begin)
        many = np.searchsorted(inner, end) - low
        total = int(many.sum())
        if total > SCAN_ROWS and len(query) > 1:
            half = len(query) // 2
            waiting += [(depth, *[x[part] for x in (query, begin, end, same, longer)]) for part in (slice(half), slice(half, None))]
            continue
        parent = np.repeat(np.arange(len(query)), many)
        child = inner[np.arange(total) - np.repeat(np.cumsum(many) - many - low, many)]
        asked, letter = query[parent], letters[child, depth]
        up = same[parent]
        beside = up + np.uint8(1)
        if depth:
            beside = np.minimum(beside, longer[parent] + (letters[asked, depth - 1] != letter))
        straight = np.minimum(up + (letters[asked, depth] != letter), 2).astype(np.uint8)
        kept = np.flatnonzero(np.minimum(straight, beside) < 2)
        asked, child, straight, beside = asked[kept], child[kept], straight[kept], beside[kept].astype(np.uint8)
        over = length[child] - length[asked]
        hit = (length[child] == depth + 1) & (np.where(over == 0, straight, beside) == 1)
        if hit.any():
            yield asked[hit], child[hit]
        stop = bounds[np.searchsorted(bounds, child, side="right")]
        going = (stop - child > 1) | (length[child] > depth + 1)
        if going.any():
            waiting.append((depth + 1, asked[going], child[going], stop[going], straight[going], beside[going]))


# ---------------------------------------------------------------- lists


def _listed(rows: DataFrame) -> DataFrame:
    """`rows` (word, n, m, p, s, within) with the key of the list: the first p and the last s letters."""
    head, tail = F.substring("word", F.lit(1), F.col("p")), F.substring("word", F.char_length("word") - F.col("s") + 1, F.col("s"))
    return rows.withColumn("key", F.xxhash64("m", "p", "s", head, tail))


def _split(rows: DataFrame) -> DataFrame:
    """Lists of words of m and m + 1 letters, dealt out by what an edit in the open middle leaves alike."""
    half = F.floor((F.col("m") - F.col("p") - F.col("s")) / 2).cast("int")
    ahead = F.col("p") + half
    bound = F.when(F.col("within") < 0, ahead).otherwise(F.least("within", ahead))
    sides = F.array(
        F.struct(ahead.alias("p"), F.col("s").alias("s"), F.col("within").alias("within")),
        F.struct(F.col("p").alias("p"), (F.col("s") + half).alias("s"), bound.alias("within")),
    )
    return _listed(rows.withColumn("side", F.explode(sides)).select("word", "n", "m", "side.*"))


def word_lists(vocab: DataFrame, limit: int = LIST_CHARS) -> DataFrame:
    """(word, n, m, p, s, within, key): every word in all lists it must be scanned in."""
    length = F.char_length("word")
    start = vocab.withColumn("m", F.explode(F.array(length, length - 1))).where("m > 0")
    zero = F.lit(0)
    rows = _split(start.select("word", "n", "m", zero.alias("p"), zero.alias("s"), F.lit(-1).alias("within")))
    done = None
    while True:
        sizes = rows.groupBy("key").agg(F.sum(F.char_length("word")).alias("chars"), F.max(F.col("m") - F.col("p") - F.col("s")).alias("open"))
        large = stored(sizes.where((F.col("chars") > limit) & (F.col("open") > 1)).select("key"), "lists")
        last = not large.limit(1).count()
        short = rows if last else rows.join(large, "key", "left_anti")
        done = short if done is None else done.unionByName(short)
        if last:
            return done
        rows = stored(_split(rows.join(large, "key", "left_semi")), "lists")


def _grouped(batches) -> Iterator[tuple[tuple, list[str], list[int]]]:
    """(values that name a list, words, occurrences) of rows that stand list by list."""
    open_key, words, counts = None, [], []
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "m", "p", "s", "within")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        found, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = tuple(keys[:, a].tolist())
            if key != open_key:
                if words:
                    yield open_key, words, counts
                open_key, words, counts = key, [], []
            words += found[a:b]
            counts += n[a:b]
    if words:
        yield open_key, words, counts


def _pairs(held: list[tuple[tuple, list[str], list[int]]]) -> Iterator[pa.RecordBatch]:
    """The pairs of some lists, each pair from the list that `within` leaves it to, two words of a length in their order."""
    turned, plain, counts, within = [], [], [], []
    for (_, _, p, s, bound), words, n in held:
        order = sorted((w[::-1] if s > p else w, k) for k, w in enumerate(words))
        turned.append([w for w, _ in order])
        plain += [words[k] for _, k in order]
        counts += [n[k] for _, k in order]
        within += [bound] * len(words)
    names, counts = np.array(plain, object), np.array(counts, np.int64)
    for query, word in scan(turned):
        kept = [
            (x, y) for x, y in zip(query.tolist(), word.tolist())
            if (len(plain[x]) < len(plain[y]) or plain[x] < plain[y]) and (within[x] < 0 or plain[x][: within[x]] != plain[y][: within[x]])
        ]
        if kept:
            x, y = np.array(kept).T
            yield pa.RecordBatch.from_arrays([pa.array(names[x], pa.string()), pa.array(counts[x]), pa.array(names[y], pa.string()), pa.array(counts[y])], names=["word", "n", "near", "near_n"])


def neighbours(vocab: DataFrame, limit: int = LIST_CHARS) -> DataFrame:
    """(word, n, near, near_n): all pairs of words one edit apart, once."""

    def work(batches):
        held, rows, width = [], 0, 0
        for key, words, counts in _grouped(batches):
            if len(words) < 2 or min(map(len, words)) > key[1]:
                continue
            wider = max(width, key[1] + 2)
            if held and (rows + len(words)) * wider > SCAN_CELLS:
                yield from _pairs(held)
                held, rows, wider = [], 0, key[1] + 2
            held.append((key, words, counts))
            rows, width = rows + len(words), wider
        if held:
            yield from _pairs(held)

    order = ["key", "m", "p", "s", "within"]
    lists = word_lists(vocab, limit).repartition("key").sortWithinPartitions(*order)
    return lists.mapInArrow(work, "word string, n bigint, near string, near_n bigint")


# ---------------------------------------------------------------- forms and roots


def follow(links: DataFrame) -> DataFrame:
    """(word, root): the links word -> form followed to their ends. Every round doubles the steps taken, and occurrences at
    least double at each step, so six rounds follow any chain."""
    steps = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        jumps = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        heavy = heavy_keys(steps.groupBy("root").count(), ["root"], "count")
        taken = salted_join(steps, jumps, ["root"], heavy, ["word"], "left")
        taken = stored(taken.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not taken.where("moved").limit(1).count():
            return taken.select("word", "root")
        steps = taken.drop("moved")


def group_variants(vocab: DataFrame, factor: int = FACTOR, limit: int = LIST_CHARS) -> DataFrame:
    """Word, form, root, n, n_near, form_n of every row (word, n).

    The form is the most frequent near word (of equally frequent ones the first in code-point order) if it is at least
    `factor` times as frequent as the word.
    """
    vocab = stored(vocab.select("word", "n"), "vocabulary")
    both = F.array(
        F.struct(F.col("word"), F.col("near"), F.col("near_n")),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    sided = neighbours(vocab, limit).select(F.explode(both).alias("pair")).select("pair.*")
    best = sided.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    taken = -F.col("best.less") >= F.col("n") * factor
    formed = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"),
    )
    formed = stored(formed, "forms")
    roots = follow(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = SLIP) -> DataFrame:
    return group_variants(vocabulary(docs, id_col, text_col, slip))
