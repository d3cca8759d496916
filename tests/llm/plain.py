"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return (text or "").translate(ASCII_LOWER)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size=5):
    w = words(lower(text))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def classes(nodes, links):
    """Node → the smallest node it reaches."""
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {n: root(n) for n in nodes}


def near_classes(rows):
    """(id, text) rows → id → (n_shingles, class), ids distinct."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in classes(ids, links).items()}


def line_keys(text):
    return [lower(x.strip(BLANKS)) for x in (text or "").split("\n")]


def kept_lines(rows, min_chars=40, min_docs=5):
    """(id, text) rows → per row (n_lines, n_dropped, kept text); a null id is below all others."""
    rank = lambda i: (i is not None, i if i is not None else 0)
    holders = defaultdict(set)
    for i, t in rows:
        for k in line_keys(t):
            if len(k) >= min_chars:
                holders[k].add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, line_keys(t)) if len(k) < min_chars or len(holders[k]) < min_docs or max(holders[k]) == rank(i)]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def mix(rows, key, cap=3):
    """(id, text, source) rows → per row (size, source size, target, taken); the filling is the stated loop."""
    sizes = [len(words(t)) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in sources}
    weight = {s: n % 3 + 1 for n, s in enumerate(sources)}
    target, full = {}, set()
    while True:
        rest = sum(total.values()) - sum(cap * total[s] for s in full)
        open_weight = sum(weight[s] for s in sources if s not in full)
        target = {s: float(cap * total[s]) if s in full else rest * weight[s] / open_weight for s in sources}
        over = {s for s in sources if s not in full and target[s] >= cap * total[s]}
        if not over:
            break
        full |= over
        if len(full) == len(sources):
            target = {s: float(cap * total[s]) for s in sources}
            break
    out = [None] * len(rows)
    for s in sources:
        own = sorted((n for n, r in enumerate(rows) if r[2] == s), key=lambda n: (key(rows[n][0]), rows[n][0] is not None, rows[n][0] or 0, sizes[n]))
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest = int(target[s] + 1e-9) - epochs * total[s]
        for n in own:
            last = max(0, min(sizes[n], rest))
            rest -= last
            out[n] = (sizes[n], total[s], target[s], epochs * sizes[n] + last)
    return out


def repeat_spans(texts, length=200):
    """Per text its maximal runs of bytes that a string of ``length`` bytes covers which also starts elsewhere."""
    data = [(t or "").encode() for t in texts]
    starts = defaultdict(int)
    for d in data:
        for i in range(len(d) - length + 1):
            starts[d[i:i + length]] += 1
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - length + 1):
            if starts[d[i:i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append(spans)
    return out


def nearest_edits(items, text):
    """The least edit distance between each item and any part of the text: one plain table a text, all items at once."""
    longest = max(map(len, items))
    letters = np.array([[ord(c) for c in t.ljust(longest, "\0")] for t in items])
    at = np.arange(longest + 1)
    row = np.tile(at, (len(items), 1))
    ends = np.array([len(t) for t in items])
    best = row[np.arange(len(items)), ends].copy()
    for c in text:
        new = np.minimum(row[:, 1:] + 1, row[:, :-1] + (letters != ord(c)))
        new = np.concatenate([np.zeros((len(items), 1), int), new], axis=1)
        row = np.minimum.accumulate(new - at, axis=1) + at  # an inserted letter costs one
        best = np.minimum(best, row[np.arange(len(items)), ends])
    return best
