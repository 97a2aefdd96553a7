"""Plain versions of what the operators compute, one document at a time."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from itertools import combinations

SPACE = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(SPACE, text or "")


def components(rows, k, num, den):
    sets = {}
    for doc_id, text, *_ in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {d: (len(s), find(d)) for d, s in sets.items()}


def covered(rows, window):
    """doc_id, text -> which words a window covers that starts in a smaller document too."""
    first = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        w = words(text)
        gone, owner = [False] * len(w), {}
        for i in range(len(w) - window + 1):
            f = first[tuple(w[i : i + window])]
            if f < doc_id:
                gone[i : i + window] = [True] * window
                owner[i] = f
        out.append((doc_id, w, gone, owner))
    return out


def canonical(text):
    folded = unicodedata.normalize("NFKC", text or "").upper().lower()
    return re.sub(r"[\t-\r\x1c-\x20\x85   ]+", " ", folded).strip(" ")


def edited(rows):
    order = sorted((d, t or "") for d, t, *_ in rows)
    for i, (d, t) in enumerate(order):
        q, nxt = len(t) // 4, order[(i + 1) % len(order)][1]
        yield d, t, t[: len(t) - q] + nxt[:q], nxt


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def targets(sizes, weights, share, cap):
    """Water filling by repetition: clamp what is above its cap, share the rest anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, clamped = share * sum(sizes.values()), set()
    while True:
        left = budget - sum(cap * sizes[s] for s in clamped)
        free = [s for s in order if s not in clamped]
        if not free:
            return {s: float(cap * sizes[s]) for s in order}
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in clamped else level * w[s] for s in order}
        clamped |= over


def entropy(text):
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text)))
