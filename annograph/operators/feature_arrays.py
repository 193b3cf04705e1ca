"""Neighbour statistics of many small samples at once, on arrays of (sample, point, other point)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CELLS = 2_000_000  # of one (sample, point, other point) array


def _quantile(ordered: np.ndarray, first: np.ndarray, size: np.ndarray, share: float) -> np.ndarray:
    """Linear quantile of `size` values of each row from `first` on."""
    row, at = np.arange(len(ordered)), (size - 1) * share
    low = np.floor(at).astype(np.int64)
    a, b = ordered[row, first + low], ordered[row, first + np.minimum(low + 1, size - 1)]
    return a + (b - a) * (at - low)


def fenced_median(ordered: np.ndarray) -> np.ndarray:
    """Median of the values of each sorted row inside the 1.5 IQR fence."""
    size, none = np.full(len(ordered), ordered.shape[1]), np.zeros(len(ordered), np.int64)
    q1, q3 = _quantile(ordered, none, size, 0.25), _quantile(ordered, none, size, 0.75)
    iqr = np.maximum(q3 - q1, 1e-6)
    kept = (ordered >= (q1 - 1.5 * iqr)[:, None]) & (ordered <= (q3 + 1.5 * iqr)[:, None])
    count = kept.sum(1)
    return _quantile(ordered, np.where(count > 0, kept.argmax(1), 0), np.where(count > 0, count, size), 0.5)


def measured(ids: np.ndarray, x: np.ndarray, y: np.ndarray, near: int, rings: tuple[float, float], radius: float, k: int) -> tuple:
    """Statistics of samples with equally many points, arrays of (sample, point) in id order: nearest, mean of the first
    `near`, spacing, both ring counts, and the others in reach as (how many, ids of all in a row)."""
    n = x.shape[1]
    dx, dy = x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :]
    d = np.sqrt(dx * dx + dy * dy)
    d[:, np.arange(n), np.arange(n)] = np.inf
    order = np.argsort(d, axis=2, kind="stable")[:, :, : n - 1]
    d = np.take_along_axis(d, order, 2)
    total = np.zeros(x.shape)
    for c in range(min(near, n - 1)):
        total = total + d[:, :, c]
    space = fenced_median(np.sort(d[:, :, 0], axis=1))
    within = lambda factor: d <= (space * factor)[:, None, None]
    reach = within(radius) | (np.arange(n - 1) < k)
    other = np.take_along_axis(np.broadcast_to(ids[:, None, :], (len(ids), n, n)), order, 2)
    return d[:, :, 0], total / max(min(near, n - 1), 1), np.repeat(space[:, None], n, 1), within(rings[0]).sum(2), within(rings[1]).sum(2), reach.sum(2), other[reach]


def nodes(points: pa.ListArray, kind: pa.ListType, near: int, rings: tuple[float, float], radius: float, k: int) -> pa.Array:
    """Nodes (a list of `kind`) of lists of points in id order; null for lists with unreadable, non-finite or repeated
    points, and for null lists."""
    sizes = points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = points.flatten()
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    owner = np.repeat(np.arange(len(points)), sizes)
    ids = values.field("id").fill_null(0).to_numpy(zero_copy_only=False)
    x, y = (values.field(c).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    odd = values.field("id").is_null().to_numpy(zero_copy_only=False) | ~np.isfinite(x) | ~np.isfinite(y)
    odd[1:] |= (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
    fits = sizes >= 2
    fits[owner[odd]] = False
    parts, at, numbers = [], [], np.zeros(len(values), np.int64)
    for n in np.unique(sizes[fits]):
        chosen = np.flatnonzero(fits & (sizes == n))
        for part in np.array_split(chosen, -(-len(chosen) * n * n // CELLS)):
            rows = first[part][:, None] + np.arange(n)
            *columns, reach = measured(ids[rows], x[rows], y[rows], near, rings, radius, k)
            at.append(rows.ravel())
            parts.append([c.ravel() for c in columns] + [np.full(rows.size, n - 1), reach])
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    joined = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0) for c in range(8)]
    nearest, mean, space, ring1, ring2, reached, others, reach = joined
    order = np.argsort(at, kind="stable")
    rows = values.take(pa.array(at[order]))
    begin = (np.concatenate([[0], np.cumsum(reached)])[:-1]).astype(np.int64)
    counts = reached[order].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    moved = np.repeat(begin[order] - offsets[:-1], counts) + np.arange(offsets[-1])
    fields = {f.name: f for f in kind.value_type}
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(reach[moved], fields["reach"].type.value_type))
    number = lambda name, c: pa.array(c[order], fields[name].type)
    columns = [
        rows.field("id"), rows.field("x"), rows.field("y"), rows.field("score"), number("nearest", nearest), number("mean3", mean), number("spacing", space),
        number("ring1", ring1.astype(np.int32)), number("ring2", ring2.astype(np.int32)), number("others", others.astype(np.int32)), lists,
    ]
    kept = np.where(fits, sizes, 0)
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=[fields[f.name] for f in kind.value_type]), mask=pa.array(~fits)
    )
