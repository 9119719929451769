"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import pairwise

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def closed(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def shingle_sets(docs, size):
    out = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def near_documents(docs, size, percent):
    sets = shingle_sets(docs, size)
    at: dict = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    links = []
    for i, s in sets.items():
        common = Counter(j for x in s for j in at[x] if j < i)
        links += [(j, i) for j, c in common.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)]
    return {i: len(s) for i, s in sets.items()}, closed(sets, links)


def near_vectors(rows, cosine):
    ids = [r[0] for r in rows]
    ok = {}
    for i, v, label in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, float)
        if label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[i] = (label, x / np.linalg.norm(x))
    links, count, keys = [], Counter(), list(ok)
    for n, i in enumerate(keys):
        for j in keys[n + 1 :]:
            if ok[i][0] == ok[j][0] and len(ok[i][1]) == len(ok[j][1]) and ok[i][1] @ ok[j][1] >= cosine:
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    return {i: count[i] for i in ids}, closed(ids, links)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(spans):
    return hashlib.sha256(joined(spans).encode()).hexdigest()


SECRET = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def secrets(text):
    found = [(m.start(), r, m.end()) for r, (_, p, ok) in enumerate(SECRET) for m in p.finditer(text or "") if ok(m)]
    return [(SECRET[r][0], s, e) for s, r, e in sorted(found)]


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end].translate(LOWER), rest[end:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def url_rule(host, path):
    best = None
    for rule in ("net/", "example.net/en/", "example.com/de/", "org/fr/"):
        h, p = rule.split("/", 1)
        if ("." + host).endswith("." + h) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return best


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m[0])) <= 15),
)


def pii(text):
    return [(k, m.start(), m.end()) for k, p, ok in PII for m in p.finditer(text or "") if ok(m)]


def repetition(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    hit = set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def longest_repeat(w):
    best = 0
    for i in range(len(w)):
        for j in range(i):
            k = 0
            while i + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
    return best


def poisson_inverse(u, mean):
    p = c = np.exp(-mean)
    k = 0
    while c <= u and k < 1000:
        k += 1
        p *= mean / k
        c += p
    return k


def gapless(numbers):
    return sorted(numbers) == list(range(len(numbers)))


def offsets_fit(rows, capacity):
    """rows: (sequence, offset, length)."""
    by: dict = {}
    for q, o, n in rows:
        by.setdefault(q, []).append((o, n))
    for places in by.values():
        places.sort()
        if places[0][0] or sum(n for _, n in places) > capacity or any(a[0] + a[1] != b[0] for a, b in pairwise(places)):
            return False
    return True
