"""Plain one-process versions that the Spark operators are compared with."""

from __future__ import annotations

import collections
import hashlib
import math
import re

UPPER = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(UPPER))


def shingles(text):
    w = words(text)
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(rows):
    """[(id, size, smallest reachable id)] in the order of ``rows`` (id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)].append(d)
    return [(d, len(s), (min(low[find(i)]) if low[find(i)] else None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def contamination(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text, ALNUM)
        for g in ([tuple(w)] if len(w) < 10 else [tuple(w[i : i + 10]) for i in range(len(w) - 9)]) if w else []:
            windows[g] |= set() if item is None else {item}
    sizes = {len(g) for g in windows}
    for d, text in rows:
        w = words(text, ALNUM)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[g]
        yield d, len(w), len(hit), sorted(found)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secrets(text):
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def edited(rows):
    """{id: (length, sha256 of the edited text)} for rows with distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 2
        out[d] = (len(t), hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest())
    return out


def unigram(rows, train):
    """[(id, tokens, known, N, base score)]; ``train(id)`` tells the training texts."""
    tokens = [(d, words(t) + [None]) for d, t in rows]
    count = collections.Counter(w for d, ws in tokens if train(d) for w in ws)
    n = sum(count.values())
    whole = math.log10(n + 0.1 * (len(count) + 1))
    return [(d, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10(count[w] + 0.1) - whole for w in ws)) for d, ws in tokens]
