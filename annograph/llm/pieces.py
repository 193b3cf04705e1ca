"""Sampled SentencePiece segmentations and lossless decoding.

All pieces that match a text form a lattice. Forward filtering sums the weights of the paths to each position; backward
sampling then draws one path from the end, with random numbers that depend on the row key only. No piece reaches over a
blank that follows other characters or over a line end, so a text is a chain of small independent lattices; each
distinct one is filtered once for a chunk of texts, and all draws of a chunk are made together. Short units, which are
nearly all, are filtered many at once, one position in all of them after the other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from annograph.llm.common import small_batches, unpack

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the piece format: the mark that stands for a blank.
BLANK = "▁"
#: Characters of text that are handled together.
CHUNK = 1_000_000
#: Bytes of a batch of rows that is sent to Python.
BATCH_BYTES = 2 << 20
#: Bytes of a short unit: the product of as many weights is a normal number, so no logarithms are needed.
SHORT = 60
#: Characters of units that are filtered at once. Numbers of short units' nodes must fit 16 bits.
SHORT_CHARS, LONG_CHARS = 1 << 16, 200_000
_BLOCK = 1 << 16  # characters that are hashed and compared at once

_BASE = np.uint64(0x100000001B3)
_STEP, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LITERAL_BLANK = 0x110000  # a code beyond Unicode, for the mark's own character in a text


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces by length as sorted hashes, their log weights, and the bytes that each id decodes to.

    The files hold merge ranks instead of probabilities; a piece weighs as its rank to the power -1 (Zipf's law).
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        size = loaded.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int64)
        by_length: dict[int, list[tuple[str, int]]] = {}
        for i in range(size):
            piece = loaded.id_to_piece(i)
            if loaded.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif loaded.is_control(i) or loaded.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
                by_length.setdefault(len(piece), []).append((piece, i))
        first = min((i for rows in by_length.values() for _, i in rows), default=0)
        self.rate = 1 / (np.maximum(np.arange(size) - first, 0) + 2.0)
        self.weight = np.log(self.rate)
        self.byte_weight = -np.log(size)
        self.n_bytes = np.array([len(b) for b in self.bytes_of], np.int32)
        self.at_byte = np.cumsum(self.n_bytes, dtype=np.int32) - self.n_bytes
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.longest = max(by_length, default=0)
        # Open addressing with all beginnings of pieces: a search ends where no piece goes on. Id -1: no piece itself.
        known = {piece[:k]: -1 for rows in by_length.values() for piece, _ in rows for k in range(1, len(piece))}
        known |= {piece: i for rows in by_length.values() for piece, i in rows}
        self.slots = np.uint64(1 << (8 * len(known)).bit_length())
        self.slot_key, self.slot_id = np.zeros(int(self.slots), np.uint64), np.zeros(int(self.slots), np.int32)
        for length in range(1, self.longest + 1):
            own = [(text, i) for text, i in known.items() if len(text) == length]
            codes = np.array([[ord(c) for c in text] for text, _ in own], np.uint64)
            keys = np.zeros(len(own), np.uint64)
            for k in range(length):
                keys = keys * _BASE + _mix(codes[:, k] + np.uint64(1))
            for key, slot, (_, i) in zip(keys.tolist(), self._slot(keys).tolist(), own):
                while self.slot_key[slot]:
                    slot = (slot + 1) % int(self.slots)
                self.slot_key[slot], self.slot_id[slot] = key, i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys ^ (keys >> np.uint64(32))) & (self.slots - np.uint64(1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is the beginning of a piece, and the id of the piece that it is itself, or -1."""
        slot = self._slot(keys)
        here = self.slot_key[slot]
        ids = self.slot_id[slot]
        found = here == keys
        again = np.flatnonzero(~found & (here != 0))
        while len(again):
            slot[again] = (slot[again] + np.uint64(1)) & (self.slots - np.uint64(1))
            here = self.slot_key[slot[again]]
            hit = again[here == keys[again]]
            found[hit], ids[hit] = True, self.slot_id[slot[hit]]
            again = again[(here != 0) & (here != keys[again])]
        return found, ids


@cache
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def _codes(texts: list[str]) -> np.ndarray:
    """Characters of all texts, each with a blank in front; blanks become the mark, and the mark a code beyond Unicode."""
    codes = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[codes == ord(BLANK)] = _LITERAL_BLANK
    codes[codes == ord(" ")] = ord(BLANK)
    return codes


def _unit_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """A unit is a line end, or characters without blanks and line ends with all blanks before them, which may stand alone."""
    blank, line_end = codes == ord(BLANK), codes == ord("\n")
    begun = line_end | blank
    begun[1:] &= line_end[1:] | ~blank[:-1]
    begun[1:] |= line_end[:-1]
    begun[text_starts] = True
    return np.flatnonzero(begun)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the hashes and of its inverse."""
    both = [np.full(1 << bits, x, np.uint64) for x in (_BASE, np.uint64(pow(int(_BASE), -1, 2**64)))]
    for x in both:
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return both[0], both[1]


def _blocks(starts: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of whole units of about `_BLOCK` characters: first and last unit, first and last character."""
    cuts = np.unique(np.r_[np.searchsorted(starts, np.arange(0, n, _BLOCK)), len(starts)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield a, b, int(starts[a]), int(starts[b]) if b < len(starts) else n


def _hashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    made = np.zeros(len(starts), np.uint64)
    for a, b, i, j in _blocks(starts, len(codes)):
        power, inverse = _powers(max(16, (j - i).bit_length()))
        made[a:b] = np.add.reduceat(codes[i:j] * power[: j - i], starts[a:b] - i) * inverse[starts[a:b] - i]
    return made


def _distinct(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each unit's kind, and one unit of each kind. Kinds come from hashes and are compared character by character."""
    found = pc.dictionary_encode(pa.array(_hashes(codes, starts)))
    which = found.indices.to_numpy()
    one = np.zeros(len(found.dictionary), np.int64)
    one[which[::-1]] = np.arange(len(starts))[::-1]
    same = np.array_equal(sizes[one][which], sizes)
    for a, b, i, j in _blocks(starts, len(codes)) if same else ():
        there = np.repeat(starts[one[which[a:b]]] - starts[a:b], sizes[a:b])
        there += np.arange(i, j)
        if not np.array_equal(codes[there], codes[i:j]):
            same = False
            break
    if not same:  # units of different characters share a hash
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        which = np.array([numbers[codes[i : i + n].tobytes()] for i, n in zip(starts.tolist(), sizes.tolist())])
        one = np.unique(which, return_index=True)[1]
    return which, one


def _raw(codes: np.ndarray) -> np.ndarray:
    """What stands for a character without a piece in place of a piece's id: below zero."""
    return -1 - np.where(codes == _LITERAL_BLANK, ord(BLANK), codes).astype(np.int32)


def _utf8_size(raw: np.ndarray) -> np.ndarray:
    return 1 + (raw < -0x80).astype(np.int64) + (raw < -0x800) + (raw < -0x10000)


def _matches(mixed: np.ndarray, step: np.ndarray, more: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """First and last character and id of all pieces found, by length; the number of pieces of each length.

    `step` leads from a character to the next one of its unit, if there are `more`.
    """
    starts, ends, ids = [], [], []
    at = end = np.arange(len(mixed))
    keys = mixed
    for _ in range(vocab.longest):
        found, which = vocab.find(keys)
        piece = np.flatnonzero(found & (which >= 0))
        starts.append(at[piece])
        ends.append(end[piece])
        ids.append(which[piece])
        on = np.flatnonzero(found & more[end])
        if not len(on):
            break
        at, end = at[on], end[on]
        end = end + step[end]
        keys = keys[on] * _BASE + mixed[end]
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(starts or empty), np.concatenate(ends or empty), np.concatenate(ids or empty).astype(np.int32), [len(x) for x in starts]


def _running(part: np.ndarray, begin: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Running sums within runs that add up to 1."""
    share = np.cumsum(part)
    share -= np.repeat(share[begin] - part[begin], run)
    share[begin + run - 1] = 1.0
    return share


def _short_units(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, ...]:
    """Lattices of units of falling size. Characters stand by position and then by unit, and a node has the number of the
    character before it, so that the nodes and the edges of one position in all units stand together."""
    longest = int(sizes[0])
    having = np.searchsorted(-sizes, -np.arange(longest), side="left")  # units that have a character at each position
    begins = np.r_[0, np.cumsum(having)]
    position = np.repeat(np.arange(longest), having)
    unit = np.arange(begins[-1]) - begins[position]
    codes = codes[starts[unit] + position]
    step = having[position]
    before = np.where(position > 0, np.arange(len(codes)) - having[position - 1], -1).astype(np.int32)
    start, target, piece, _ = _matches(_mix(codes.astype(np.uint64) + np.uint64(1)), step, position + 1 < sizes[unit], vocab)
    single = np.zeros(len(codes), bool)
    single[start[start == target]] = True
    raw = np.flatnonzero(~single)
    if len(raw):
        start, target, piece = np.r_[start, raw], np.r_[target, raw], np.r_[piece, _raw(codes[raw])]
    order = np.argsort(target.astype(np.uint16), kind="stable")
    source, piece = before[start[order]], piece[order]
    weight = vocab.rate[np.maximum(piece, 0)]
    if len(raw):
        is_raw = np.flatnonzero(piece < 0)
        weight[is_raw] = np.exp(_utf8_size(piece[is_raw]) * vocab.byte_weight)
    run = np.bincount(target, minlength=len(codes))
    begin = np.cumsum(run) - run
    bounds = np.r_[begin, len(source)][begins]
    alpha = np.ones(len(codes) + 1)  # the last one is the beginning of all units
    for a, b, i, j in zip(bounds[:-1], bounds[1:], begins[:-1], begins[1:]):
        weight[a:b] *= alpha[source[a:b]]
        alpha[i:j] = np.add.reduceat(weight[a:b], begin[i:j] - a)
    weight /= np.repeat(alpha[:-1], run)
    return source, _running(weight, begin, run), piece, begin, begins[sizes - 1] + np.arange(len(sizes))


def _long_units(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, ...]:
    """Lattices of any units, in logarithms. Node of a position is its offset in the characters plus the unit's number:
    each unit has one node more than characters. Filtering starts anew at nodes that no edge passes over."""
    ends = np.cumsum(sizes)
    codes = codes[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters to the unit's end
    start, end, piece, runs = _matches(_mix(codes.astype(np.uint64) + np.uint64(1)), np.ones(len(codes), np.int64), left > 1, vocab)
    length = end - start + 1
    single = np.zeros(len(codes), bool)
    single[start[length == 1]] = True
    raw = np.flatnonzero(~single)
    start, length = np.r_[start, raw], np.r_[length, np.ones(len(raw), np.int64)]
    n_raw = len(piece)
    piece = np.r_[piece, _raw(codes[raw])]
    weight = np.r_[vocab.weight[piece[:n_raw]], _utf8_size(piece[n_raw:]) * vocab.byte_weight]
    source = start + np.repeat(np.arange(len(sizes)), sizes)[start]
    target = source + length
    nodes = len(codes) + len(sizes)
    # Edges of one length have different targets, so each length in turn fills the next free place of its targets.
    run = np.bincount(target, minlength=nodes)
    begin = np.cumsum(run) - run
    place, free = np.zeros(len(start), np.int64), begin.copy()
    bounds = np.cumsum([0, *runs, len(raw)])
    for a, b in zip(bounds[:-1], bounds[1:]):
        place[a:b] = free[target[a:b]]
        free[target[a:b]] += 1
    order = np.empty(len(start), np.int64)
    order[place] = np.arange(len(start))
    source, target, weight, piece = source[order], target[order], weight[order], piece[order]
    filled = run > 0
    share = _running(_parts(source, target, weight, nodes), begin[filled], run[filled])
    first = ends - sizes + np.arange(len(sizes))
    opening = np.zeros(nodes, bool)
    opening[first] = True
    return np.where(opening[source], -1, source).astype(np.int32), share, piece, begin, first + sizes


def _parts(source: np.ndarray, target: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
    """Share of the path weight into its target node that each edge has."""
    covered = np.bincount(source + 1, minlength=nodes + 1) - np.bincount(target, minlength=nodes + 1)
    cut = np.cumsum(covered)[:nodes] == 0  # no edge passes over these nodes: filtering may start anew
    begun = np.maximum.accumulate(np.where(cut, np.arange(nodes), 0))
    depth_of = target - begun[target - 1]
    alpha = np.zeros(nodes)
    part = np.zeros(len(target))
    turns = np.argsort(depth_of.astype(np.uint16), kind="stable") if depth_of.max(initial=0) < 2**16 else np.argsort(depth_of, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(depth_of[turns]) > 0, True]) if len(turns) else [0]
    for a, b in zip(bounds[:-1], bounds[1:]):
        edges = turns[a:b]
        into = target[edges]
        begin = np.flatnonzero(np.r_[True, into[1:] != into[:-1]])
        run = np.diff(np.r_[begin, len(into)])
        value = np.where(cut[source[edges]], 0.0, alpha[source[edges]]) + weight[edges]
        top = np.repeat(np.maximum.reduceat(value, begin), run)
        mass = np.exp(value - top)
        total = np.add.reduceat(mass, begin)
        alpha[into[begin]] = top[begin] + np.log(total)
        part[edges] = mass / np.repeat(total, run)
    return part


class Lattice:
    """Filtered lattices of distinct units. The edges into a node stand together from `begin` of the node, by length.

    An edge has its `source` node (-1: the unit's beginning), its `share`, which is that of the edges up to it in the path
    weight into the node, and its `piece`: an id, or below zero a character without one. `last` is each unit's last node.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> None:
        n_bytes = np.ones(len(codes) + 1, np.int8)
        for least in (0x80, 0x800, 0x10000):
            n_bytes[:-1] += codes >= least
        reach = np.cumsum(n_bytes, dtype=np.int64)
        long = reach[starts + sizes] - reach[starts] > SHORT
        del n_bytes, reach
        order = np.lexsort((-sizes, long))
        n_short = len(sizes) - int(long.sum())
        made: tuple[list[np.ndarray], ...] = ([], [], [], [])
        nodes = edges = 0
        self.last = np.zeros(len(sizes), np.int64)
        for own, make, chars in ((order[:n_short], _short_units, SHORT_CHARS), (order[n_short:], _long_units, LONG_CHARS)):
            reach = np.cumsum(sizes[own])
            i = 0
            while i < len(own):
                j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + chars, side="right")))
                now = own[i:j]
                source, share, piece, begin, last = make(codes, starts[now], sizes[now], vocab)
                self.last[now] = last + nodes
                source[source >= 0] += nodes
                for parts, part in zip(made, (source, share, piece, (begin + edges).astype(np.int32))):
                    parts.append(part)
                nodes, edges = nodes + len(begin), edges + len(source)
                i = j
        joined = []
        for parts in made:
            joined.append(np.concatenate(parts))
            parts.clear()
        self.source, self.share, self.piece, self.begin = joined

    def draw(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One path for each occurrence of a unit: (pieces of all paths in order, number of pieces of each path)."""
        node = self.last[unit]
        who = np.argsort(node)  # neighbours in one lattice are looked up one after another
        node, seed = node[who], seed[who]
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(unit), np.int64)
        while len(who):
            random = (_mix(seed + np.uint64(len(taken) + 1) * _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.begin[node]
            on = np.flatnonzero(self.share[edge] <= random)
            while len(on):
                edge[on] += 1
                on = on[self.share[edge[on]] <= random[on]]
            taken.append((who, self.piece[edge]))
            count[who] = len(taken)
            node = self.source[edge]
            on = np.flatnonzero(node >= 0)
            who, node, seed = who[on], node[on], seed[on]
        after = np.cumsum(count)
        path = np.zeros(int(after[-1]) if len(after) else 0, np.int32)
        for step, (rows, piece) in enumerate(taken, 1):
            path[after[rows] - step] = piece
        return path, count


def _byte_ids(path: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """`path` with the ids of the bytes of each character without a piece, and the number of ids of each place."""
    count = np.ones(len(path), np.int64)
    raw = np.flatnonzero(path < 0)
    if not len(raw):
        return path, count
    kinds, which = np.unique(path[raw], return_inverse=True)
    table = np.zeros((len(kinds), 4), np.int32)
    for row, kind in zip(table, kinds.tolist()):
        own = chr(-1 - kind).encode("utf-8", "surrogatepass")
        row[: len(own)] = vocab.byte_ids[list(own)]
    count[raw] = _utf8_size(path[raw])
    flat = np.repeat(path, count)
    flat[flat < 0] = table[which][np.arange(4) < count[raw][:, None]]
    return flat, count


def encode_texts(texts: list[str], keys: np.ndarray, vocab: Vocabulary, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts in a row, and the number of ids of each text."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    codes = _codes(texts)
    if not len(codes):
        return np.zeros(0, np.int32), sizes
    starts = _unit_starts(codes, (ends - sizes)[sizes > 0])
    bounds = np.r_[0, np.searchsorted(starts, ends)]
    lens = np.diff(bounds)
    sizes = np.diff(np.r_[starts, len(codes)])
    which, one = _distinct(codes, starts, sizes)
    lattice = Lattice(codes, starts[one], sizes[one], vocab)
    del codes
    number = np.arange(len(which)) - np.repeat(bounds[:-1], lens)
    with np.errstate(over="ignore"):
        row = _mix(keys.astype(np.uint64) + _mix(np.uint64([seed % 2**64])))
        path, count = lattice.draw(which, _mix(np.repeat(row, lens) + number.astype(np.uint64) * _MIX2))
    ends = np.r_[0, np.cumsum(count)][bounds]
    flat, count = _byte_ids(path, vocab)
    return flat, np.diff(np.r_[0, np.cumsum(count)][ends])


def decode_texts(ids: np.ndarray, n: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts that were encoded, in a row without the blanks put in front, and the bounds of the texts."""
    size = vocab.n_bytes[ids]
    ends = np.r_[0, np.cumsum(size, dtype=np.int64)]
    place = np.repeat((vocab.at_byte[ids] - ends[:-1]).astype(np.int32), size)
    place += np.arange(len(place), dtype=np.int32)
    own = vocab.all_bytes[place]
    bounds = ends[np.r_[0, np.cumsum(n)]]
    filled = np.diff(bounds) > 0
    kept = np.ones(len(own), bool)
    kept[bounds[:-1][filled]] = False
    return own[kept], bounds - np.r_[0, np.cumsum(filled)]


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text that was encoded: the bytes of the pieces without the blank put in front."""
    return b"".join([vocab.bytes_of[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


def decode(ids: Column, model: str = MODEL) -> Column:
    """Text of an array of piece ids; null ids give an empty text."""

    @F.arrow_udf("string")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(model)
        for lists in batches:
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            yield pa.array([decode_ids(values[a:b], vocab) for a, b in zip(ends[:-1], ends[1:])], pa.string())

    return joined(F.coalesce(ids, F.array().cast("array<int>")))


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, seed: int = 0, decoded: bool = False) -> DataFrame:
    """The columns of `docs` plus `ids` (array of piece ids), `n_ids` and, if asked for, `decoded`, the text of the ids.

    The segmentation of a row depends on its id, its text and `seed` only, not on partitions or batches; rows with equal
    id and text get equal ids, and null ids count as one key. Characters without a piece, and the blank mark itself,
    become byte pieces, so the ids always decode to the text; one that does not ends the job. Null and empty texts have
    no ids. Existing columns of the added names are replaced.
    """
    small_batches(docs.sparkSession, BATCH_BYTES)
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col)).alias("key"))
    added = {"ids": T.ArrayType(T.IntegerType()), "n_ids": T.LongType()} | ({"decoded": T.StringType()} if decoded else {})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        pa.default_memory_pool().release_unused()  # a reused worker may hold what earlier steps freed
        for batch in batches:
            texts = pc.fill_null(pc.struct_field(batch.column("row"), text_col), "").cast(pa.large_string())
            reach = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            there = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            i = 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + CHUNK, side="right")))
                ids, n = encode_texts(texts.slice(i, j - i).to_pylist(), keys[i:j], vocab, seed)
                back, bounds = decode_texts(ids, n, vocab)
                if not np.array_equal(bounds, at[i : j + 1] - at[i]) or not np.array_equal(back, there[at[i] : at[j]]):
                    raise ValueError("a segmentation does not decode to its text")
                ends = np.r_[0, np.cumsum(n)]
                columns = [batch.column("row").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(n, pa.int64())]
                if decoded:
                    columns.append(pa.StringArray.from_buffers(j - i, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(back)))
                yield pa.RecordBatch.from_arrays(columns, names=["row", *added])
                i = j

    schema = T.StructType([rows.schema["row"], *[T.StructField(n, kind) for n, kind in added.items()]])
    return unpack(rows.mapInArrow(code, schema), {n: F.col(n) for n in added})
