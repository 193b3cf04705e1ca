"""Plain restatements of the operators' rules, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def line_dedup(docs, min_chars=20, min_docs=3):
    """docs: (id, text) -> (id, lines, dropped, text)"""
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= min_chars:
                holders[key].add(i)
    keeper = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := x.strip(SPACE).translate(LOWER)) not in keeper or keeper[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def contamination(docs, items, size=13):
    """-> (id, words, hit, sorted items, contaminated)"""
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in {min(size, len(w))} - {0}:
            for i in range(len(w) - k + 1):
                grams[tuple(w[i : i + k])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for at in range(len(w) - k + 1):
                if (g := tuple(w[at : at + k])) in grams:
                    hit |= set(range(at, at + k))
                    found |= {str(x) for x in grams[g] if x is not None}
        out.append((i, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def shingle_counts(text):
    w = words(text)
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def near_classes(docs, similar):
    """Class (smallest id) of each position of docs; `similar` compares two shingle counters."""
    sets = [shingle_counts(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for n, s in enumerate(sets):
        for g in s:
            holders[g].append(n)
    for a, b in {(x, y) for v in holders.values() for x in v for y in v if x < y}:
        if similar(sets[a], sets[b]):
            parent[root(a)] = root(b)
    groups = defaultdict(list)
    for n in range(len(docs)):
        groups[root(n)].append(n)
    out = [None] * len(docs)
    for members in groups.values():
        first = min(docs[n][0] for n in members)
        for n in members:
            out[n] = first
    return out


def repeats(docs, length=200):
    """-> (id, bytes, removed, spans, kept)"""
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[i : i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = [False] * len(t)
        for at in range(len(t) - length + 1):
            if seen[t[at : at + length]] > 1:
                gone[at : at + length] = [True] * length
        spans = sum(g and (n == 0 or not gone[n - 1]) for n, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def quality(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed
