"""Graph rules of many documents at once on their columns: ids sorted once, ends of links looked up in them, repeats by key.

Takes the raw elements of a batch of documents as Arrow list arrays and gives what the column expressions of `normalize` give
for each. Linear in the elements but for the sorting, and only ids of documents with repeated ids are gone through one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from annograph.schemas import ISSUE_TEXT

_POINT = pa.struct([("id", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("score", pa.float64()), ("source", pa.string())])
_EDGE = pa.struct([("edge_id", pa.string()), ("src", pa.int32()), ("dst", pa.int32()), ("label", pa.int32()), ("source", pa.string())])
_ISSUE = pa.struct([("part", pa.int32()), ("pos", pa.int32()), ("level", pa.string()), ("code", pa.string()), ("message", pa.string())])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and where they are."""
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), _flags(column.is_valid())


def _flags(column: pa.Array, null: bool = False) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False)


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted keys differs from the row before."""
    out = np.ones(len(sorted_keys[0]), bool)
    out[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return out


def _within(doc: np.ndarray) -> np.ndarray:
    """Number of each row in its document, from 0; rows come document by document."""
    start = np.maximum.accumulate(np.where(_firsts(doc), np.arange(len(doc)), 0))
    return np.arange(len(doc)) - start


def assigned(doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ids after a repeated one took the next number above all its document gave so far (and at least 0)."""
    order = np.lexsort((ids, doc))
    repeated = doc[order][~_firsts(doc[order], ids[order])]
    if not len(repeated):
        return ids
    given = ids.copy()
    rows = np.flatnonzero(np.isin(doc, repeated))
    now, used, top, changed, values = -1, set(), 0, [], []
    for k, d, i in zip(rows.tolist(), doc[rows].tolist(), ids[rows].tolist()):
        if d != now:
            now, used, top = d, set(), 0
        if i in used:
            i = top
            changed.append(k)
            values.append(i)
        used.add(i)
        if i >= top:
            top = i + 1
    given[changed] = values
    return given


class _Issues:
    """Issues of a batch, gathered rule by rule and put in order at the end."""

    def __init__(self, detail: str):
        self.detail, self.parts = detail, []

    def add(self, part: int, rows: np.ndarray, doc: np.ndarray, pos: pa.Array, code: str, *args: pa.Array) -> None:
        if self.detail == "none" or not len(rows):
            return
        at = pa.array(rows)
        pos, n = pos.take(at).cast(pa.int32()), len(rows)
        if self.detail == "messages":
            text = ISSUE_TEXT[code].replace("%d", "%s")
            values = zip(*[["null" if v is None else v for v in a.take(at).to_pylist()] for a in (args or (pos,))])
            messages = pa.array([text % v for v in values] if args else [text] * n, pa.string())
        else:
            messages = pa.nulls(n, pa.string())
        columns = [pa.array(doc[rows]), pa.repeat(pa.scalar(part, pa.int32()), n), pos, pa.repeat("error", n), pa.repeat(code, n), messages]
        self.parts.append(pa.table(columns, names=["doc", *[f.name for f in _ISSUE]]))

    def array(self) -> tuple[np.ndarray, pa.Array]:
        """(document of each issue, issues)"""
        if not self.parts:
            return np.zeros(0, np.int64), pa.array([], _ISSUE)
        found = pa.concat_tables(self.parts)
        keys = [(name, "ascending") for name in ("doc", "part", "pos", "code", "message")]
        found = found.take(pc.sort_indices(found, sort_keys=keys, null_placement="at_start")).combine_chunks()
        whole = lambda name: found.column(name).combine_chunks()
        return whole("doc").to_numpy(), pa.StructArray.from_arrays([whole(f.name) for f in _ISSUE], fields=list(_ISSUE))


def _elements(lists: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(document of each element, fields of the elements) of a list array."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    elements = lists.flatten()
    return np.repeat(np.arange(len(lists)), sizes), dict(zip([f.name for f in elements.type], elements.flatten()))


def graphs(points: pa.Array, edges: pa.Array, detail: str) -> pa.Array:
    """struct<points, edges, issues> of each document of two list arrays, null where `points` is null. Where only `edges` is
    null, so are its links and issues."""
    issues = _Issues(detail)
    doc, p = _elements(points)
    is_object, not_object = _flags(p["is_object"]), ~_flags(p["is_object"], True)
    ids, has_id = _numbers(p["id"])
    readable = is_object & has_id & _flags(p["x"].is_valid()) & _flags(p["y"].is_valid())
    rows = np.flatnonzero(readable)
    given = assigned(doc[rows], ids[rows])
    order = np.lexsort((given, doc[rows]))
    known_doc, known = doc[rows][order], given[order]
    kept = {name: column.take(pa.array(rows[order])) for name, column in p.items()}
    new_ids = _within(known_doc)
    issues.add(1, np.flatnonzero(not_object), doc, p["pos"], "POINT_NOT_OBJECT", p["pos"])
    issues.add(1, np.flatnonzero(is_object & ~readable), doc, p["pos"], "POINT_INVALID", p["pos"])
    issues.add(1, rows[_flags(p["score"].is_null())[rows]], doc, p["pos"], "VALUE_INVALID", p["pos"])
    issues.add(1, rows[given != ids[rows]], doc, p["pos"], "POINT_ID_DUP", p["id"])
    new_points = pa.StructArray.from_arrays(
        [pa.array(new_ids.astype(np.int32)), *[kept[n].cast(pa.float64()) for n in ("x", "y")], kept["score"].cast(pa.float64()).fill_null(1.0), kept["source"]],
        fields=list(_POINT),
    )

    link_doc, e = _elements(edges)
    not_object = ~_flags(e["is_object"], True)
    (src, has_src), (dst, has_dst) = _numbers(e["src"]), _numbers(e["dst"])
    readable = ~not_object & has_src & has_dst
    numbers, codes = np.unique(known, return_inverse=True)
    key = known_doc * len(numbers) + codes

    def place(end: np.ndarray) -> np.ndarray:
        """Row of an end among the kept points of the batch, -1 for none."""
        code = np.searchsorted(numbers, end)
        found = code < len(numbers)
        found[found] = numbers[code[found]] == end[found]
        asked = link_doc * len(numbers) + code
        at = np.searchsorted(key, asked)
        found &= at < len(key)
        found[found] = key[at[found]] == asked[found]
        return np.where(found, at, -1)

    a, b = place(src), place(dst)
    low, high = np.minimum(a, b), np.maximum(a, b)
    dangling, loop = readable & (low < 0), readable & (low >= 0) & (low == high)
    proper = np.flatnonzero(readable & (low >= 0) & (low != high))
    _, first = np.unique(low[proper] << 32 | high[proper], return_index=True)
    wins = np.zeros(len(proper), bool)
    wins[first] = True
    links = proper[wins]
    issues.add(2, np.flatnonzero(not_object), link_doc, e["pos"], "EDGE_NOT_OBJECT", e["pos"])
    issues.add(2, np.flatnonzero(~not_object & ~readable), link_doc, e["pos"], "EDGE_INVALID", e["pos"])
    issues.add(2, np.flatnonzero(dangling), link_doc, e["pos"], "EDGE_DANGLING", e["pos"], e["src"], e["dst"])
    issues.add(2, np.flatnonzero(loop), link_doc, e["pos"], "EDGE_SELF_LOOP", e["pos"])
    issues.add(2, proper[~wins], link_doc, e["pos"], "EDGE_DUP", e["pos"])
    issues.add(2, links[_flags(e["label"].is_null())[links]], link_doc, e["pos"], "VALUE_INVALID", e["pos"])
    taken = {name: column.take(pa.array(links)) for name, column in e.items()}
    places = _within(link_doc[links])
    names = pa.array([f"edge_{n + 1:04d}" for n in range(places.max(initial=-1) + 1)], pa.string()).take(pa.array(places))
    edge_ids = taken["edge_id"].cast(pa.string())
    named = pc.fill_null(pc.not_equal(edge_ids, ""), False)
    ends = [pa.array(new_ids[end[links]].astype(np.int32)) for end in (low, high)]
    new_edges = pa.StructArray.from_arrays(
        [pc.if_else(named, edge_ids, names), *ends, taken["label"].cast(pa.int32()).fill_null(1), taken["source"]], fields=list(_EDGE)
    )

    def lists(owner: np.ndarray, values: pa.Array, unknown: pa.Array | None = None) -> pa.Array:
        ends = np.cumsum(np.bincount(owner, minlength=len(points)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values, mask=unknown)

    no_links = edges.is_null()
    found = lists(*issues.array(), None if detail == "none" else no_links)
    parts = [lists(known_doc, new_points), lists(link_doc[links], new_edges, no_links), found]
    return pa.StructArray.from_arrays(parts, names=["points", "edges", "issues"], mask=points.is_null())
