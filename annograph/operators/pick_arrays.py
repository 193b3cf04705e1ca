"""Greedy choice of links in many small groups at once: each round takes the best link of every group.

The same rules as `predict.pick_links`, on arrays of (group, link) and (group, node). Groups that do not fit such arrays
are left to that function.
"""

from __future__ import annotations

import numpy as np

LINKS, NODES = 256, 63  # of one group here
CELLS = 400_000  # of one (group, link) array


def _straight(at: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """`predict.straight` on (..., 2) arrays."""
    a, b = one - at, other - at
    size_a, size_b = np.sqrt(a[..., 0] * a[..., 0] + a[..., 1] * a[..., 1]), np.sqrt(b[..., 0] * b[..., 0] + b[..., 1] * b[..., 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = (a[..., 0] * b[..., 0] + a[..., 1] * b[..., 1]) / (size_a * size_b)
    return np.where(np.minimum(size_a, size_b) < 1e-6, 0.0, (1.0 - np.clip(cosine, -1.0, 1.0)) / 2)


def _near_steps(near: np.ndarray, start: np.ndarray, goal: np.ndarray, steps: int) -> np.ndarray:
    """`predict.within_steps` in each group; `near` holds the neighbours of each node as bits."""
    one = np.uint64(1)
    bits = np.arange(near.shape[1], dtype=np.uint64)
    seen = ring = one << start.astype(np.uint64)
    aim = one << goal.astype(np.uint64)
    for _ in range(min(steps, near.shape[1])):
        there = (ring[:, None] >> bits) & one != 0
        ring = np.bitwise_or.reduce(np.where(there, near, np.uint64(0)), axis=1) & ~seen
        seen = seen | ring
    return seen & aim != 0


def _rounds(src, dst, score, places, max_degree: int, max_cycle: int, weight: float):
    """Picks (group, link, floor, link at the floor, turn) of arrays (group, link); missing links have score -inf.

    `places`: (group, node, 2), nan where unknown; None without a bonus.
    """
    groups, nodes = np.arange(len(src)), int(max(src.max(), dst.max())) + 1
    value = score.copy()
    near = np.zeros((len(src), nodes), np.uint64)
    degree, lone = np.zeros((len(src), nodes), np.int32), np.full((len(src), nodes), -1, np.int32)
    floor, at, turn = np.full(len(src), np.inf), np.full(len(src), -1), np.zeros(len(src), np.int32)
    known = None if places is None else ~np.isnan(places[..., 0])
    out = []
    while True:
        best = value.argmax(1)
        row = np.arange(len(best))
        going = value[row, best] > -np.inf
        if not going.all():
            if not going.any():
                break
            groups, src, dst, score, value, near, degree, lone, floor, at, turn, best = (c[going] for c in (groups, src, dst, score, value, near, degree, lone, floor, at, turn, best))
            if known is not None:
                places, known = places[going], known[going]
            row = np.arange(len(best))
        top = value[row, best]
        value[row, best] = -np.inf
        a, b = src[row, best], dst[row, best]
        if max_cycle >= 3:
            free = np.flatnonzero(~_near_steps(near, a, b, max_cycle - 1))
        else:
            free = row
        a, b, best, top = a[free], b[free], best[free], top[free]
        later = (top < floor[free]) | ((top == floor[free]) & (best > at[free]))
        floor[free], at[free] = np.where(later, top, floor[free]), np.where(later, best, at[free])
        out.append((groups[free], best, floor[free], at[free], turn[free]))
        turn[free] += 1
        for here, there in ((a, b), (b, a)):
            degree[free, here] += 1
            near[free, here] |= np.uint64(1) << there.astype(np.uint64)
            alone = near[free, here] & (near[free, here] - np.uint64(1)) == 0
            lone[free, here] = np.where(alone, there, -1)
        u, v, g = src[free], dst[free], np.arange(len(free))[:, None]
        open_ = value[free] > -np.inf
        open_ &= (degree[free][g, u] < max_degree) & (degree[free][g, v] < max_degree)
        fresh = score[free].copy()
        if known is not None:
            for here, there in ((u, v), (v, u)):
                mate = lone[free][g, here]
                r, c = np.nonzero(open_ & (mate >= 0))
                h, t, m = here[r, c], there[r, c], mate[r, c]
                f = free[r]
                fit = known[f, h] & known[f, t] & known[f, m]
                r, c, h, t, m, f = (x[fit] for x in (r, c, h, t, m, f))
                fresh[r, c] += weight * _straight(places[f, h], places[f, m], places[f, t])
        value[free] = np.where(open_, fresh, -np.inf)
    return [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(5)]


def pick(group, src, dst, score, spots, max_degree: int, max_cycle: int, weight: float):
    """(done, picks): which groups were worked out, and their picks (row, floor, row at the floor, turn).

    `group`: sorted group numbers from 0 of the links, which stand in list order. `spots`: (group, id, x, y) or None.
    """
    n = int(group[-1]) + 1 if len(group) else 0
    low = min(int(src.min()), int(dst.min())) if len(group) else 0
    wide = (max(int(src.max()), int(dst.max())) - low + 1) if len(group) else 1
    key = lambda g, ids: g.astype(np.int64) * wide + (ids.astype(np.int64) - low)
    nodes, place = np.unique(np.concatenate([key(group, src), key(group, dst)]), return_inverse=True)
    owner = nodes // wide
    first_node, first_link = np.searchsorted(owner, np.arange(n)), np.searchsorted(group, np.arange(n))
    links, sizes = np.bincount(group, minlength=n), np.bincount(owner, minlength=n)
    odd = np.zeros(n, bool)
    odd[group[(src == dst) | ~np.isfinite(score)]] = True
    places = None
    if spots is not None:
        places = np.full((len(nodes), 2), np.nan)
        own, ids, x, y = spots
        inside = (ids >= low) & (ids < low + wide) & (own < n)
        own, ids, x, y = own[inside], ids[inside], x[inside], y[inside]
        at = np.searchsorted(nodes, key(own, ids))
        hit = at < len(nodes)
        hit[hit] = nodes[at[hit]] == key(own, ids)[hit]
        odd[own[hit & ~(np.isfinite(x) & np.isfinite(y))]] = True
        places[at[hit], 0], places[at[hit], 1] = x[hit], y[hit]
    done = (links > 0) & (links <= LINKS) & (sizes <= NODES) & ~odd
    a, b = place[: len(group)] - first_node[group], place[len(group) :] - first_node[group]
    column = np.arange(len(group)) - first_link[group]
    found = []
    for width in [2**k for k in range(2, LINKS.bit_length())]:
        chosen = np.flatnonzero(done & (links <= width) & ((links > width // 2) | (width == 4)))
        for part in np.array_split(chosen, max(1, -(-len(chosen) * width // CELLS))):
            if not len(part):
                continue
            number = np.full(n, -1)
            number[part] = np.arange(len(part))
            rows = np.flatnonzero(number[group] >= 0)
            r, c = number[group[rows]], column[rows]
            s, d = np.zeros((len(part), width), np.int64), np.zeros((len(part), width), np.int64)
            values = np.full((len(part), width), -np.inf)
            s[r, c], d[r, c], values[r, c] = a[rows], b[rows], score[rows]
            local = None
            if places is not None:
                local = np.full((len(part), int(sizes[part].max()), 2), np.nan)
                mine = np.flatnonzero(number[owner] >= 0)
                local[number[owner[mine]], mine - first_node[owner[mine]]] = places[mine]
            g, link, floor, at, turn = _rounds(s, d, values, local, max_degree, max_cycle, weight)
            first = first_link[part][g.astype(np.int64)]
            found.append((first + link, floor, first + at, turn))
    picks = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4)]
    return done, picks
