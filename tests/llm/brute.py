"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, x, y):
        self[self.find(x)] = self.find(y)


def similar(rows, width, percent):
    """(set size, group) of every row; a group is named by its smallest row number."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    groups = Groups()
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                groups.join(i, j)
    return [(len(x), groups.find(i)) for i, x in enumerate(sets)]


def without_repeats(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _near(a, b, most):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (c != d)))
        row = new
    return row[-1] <= most


def fuzzy_lines(rows):
    """The occurrence that stays, for every line with a word."""
    lines = []
    for d, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            key = " ".join(re.sub(r"[^\w]|_", " ", line.lower()).split())
            if key:
                lines.append((key, d, n))
    hashes = {}
    for key in {k for k, _, _ in lines if len(k.split()) >= 5}:
        words = key.split()
        counts = [sum(xxhash.xxh64_intdigest(w, seed=42) >> j & 1 for w in words) for j in range(64)]
        hashes[key] = sum(1 << j for j in range(64) if 2 * counts[j] > len(words))
    groups = Groups()
    for x in hashes:
        for y in hashes:
            near = x < y and (hashes[x] ^ hashes[y]).bit_count() <= 3
            if near and _near(x, y, int(0.1 * max(len(x), len(y)) + 1e-9)):
                groups.join(x, y)
    first = {}
    for key, d, n in lines:
        g = groups.find(key)
        first[g] = min(first.get(g, (d, n)), (d, n))
    return {(d, n): first[groups.find(k)] for k, d, n in lines}
