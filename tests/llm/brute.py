"""Plain definitions of what the corpus operators compute."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def bench_words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(ASCII_LOWER)) if w]


def components(docs: list[tuple], n=5, percent=75) -> dict:
    """doc_id: (size of the set, component)."""
    sets = {}
    for d, t in docs:
        w = words((t or "").translate(ASCII_LOWER))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def leaks(docs, items, window=10) -> dict:
    wins = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k : k + window])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = bench_words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in wins:
                    hit |= set(range(k, k + size))
                    found |= wins[x]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def least_capacity(sizes: list[int], shards: int) -> int:
    """By the recurrence over all last cuts."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = list(sums)
    for _ in range(shards - 1):
        best = [min((max(best[j], sums[i] - sums[j]) for j in range(i + 1)), default=0) for i in range(len(sums))]
    return best[-1]


ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def base_secrets(text):
    t = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def measures(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def targets(sizes: dict, weights=(1, 2, 3), most=3.0) -> dict:
    """By resharing the excess until none is left. Sources by code point, null last."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}
        if len(capped) == len(order):
            return capped


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
