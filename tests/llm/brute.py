"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

ASCII_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


class Groups:
    """Union-find with the smallest member as root."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def near_duplicates(docs, size=3, percent=85):
    """{id: (shingles, component)} for (id, text) pairs."""
    sets = [(i, shingle_set(t, size)) for i, t in docs]
    groups = Groups()
    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            shared = len(s & t)
            if a is not None and b is not None and s and t and 100 * shared >= percent * (len(s) + len(t) - shared):
                groups.join(a, b)
    return {i: (len(s), None if i is None else groups.find(i)) for i, s in sets}


def repeated_lines(docs, least_words=10):
    """{id: kept text} for (id, text) pairs with different ids, null ids left alone."""
    lines = []  # in text order: document, line number, line, position among those that are not blank
    for i, text in sorted((d for d in docs if d[0] is not None and d[1] is not None), key=lambda d: d[0]):
        p = 0
        for q, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\r")
            if line:
                lines.append((i, q, line, p))
                p += 1
    gone = set()
    for b in range(len(lines)):
        for a in range(b):
            n, words = 0, 0
            while b + n < len(lines):
                x, y = lines[a + n], lines[b + n]
                if x[0] != lines[a][0] or y[0] != lines[b][0] or x[2] != y[2]:
                    break
                words += len([w for w in re.split(r"[ \t\r]+", y[2]) if w])
                n += 1
            if n and words >= least_words:
                gone |= {(lines[b + k][0], lines[b + k][1]) for k in range(n)}
    found = {}
    for i, text in docs:
        if i is None or text is None or not any(g[0] == i for g in gone):
            found[i] = text
            continue
        kept = [raw for q, raw in enumerate(text.split("\n")) if (i, q) not in gone]
        found[i] = "\n".join(kept) if any(k.strip(" \t\r") for k in kept) else ""
    return found


def contaminated(docs, items, size=5, percent=80):
    """{(document, item): (similarity, first word)} of the best window."""
    def shingles(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return [tuple(words[k:k + size]) for k in range(len(words) - size + 1)]

    found = {}
    for i, text in docs:
        own = shingles(text)
        for item, other in items:
            wanted = Counter(shingles(other))
            span = min(wanted.total(), len(own))
            if not wanted or not span:
                continue
            for start in range(len(own) - span + 1):
                shared = (Counter(own[start:start + span]) & wanted).total()
                union = span + wanted.total() - shared
                if 100 * shared >= percent * union and shared / union > found.get((i, item), (0, 0))[0]:
                    found[i, item] = (shared / union, start)
    return found
