"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def substring_dedup(docs, width=20):
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), (d, i))
    out = []
    for d, t in docs:
        w = words[d]
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (d, i):
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), sha(" ".join(kept).encode())))
    return sorted(out)


def byte_dedup(docs, width=200):
    body = {d: (t or "").encode() for d, t in docs}
    seen = Counter(b[i : i + width] for b in body.values() for i in range(len(b) - width + 1))
    out = []
    for d, t in docs:
        b = body[d]
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), runs, sha(kept)))
    return sorted(out)


def shingles(text, k):
    w = WORD.findall(ascii_lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_dedup(docs, k=3, percent=85):
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            index[g].append(d)
    common = Counter()
    for ids in index.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] += 1
    for (a, b), both in common.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d, _ in docs)


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def decontaminate(docs, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall(ascii_lower(t or ""))
        n = min(len(w), width)
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(str(i))
    out = []
    for d, t in docs:
        w = ITEM_WORD.findall(ascii_lower(t or ""))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    found |= who
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return sorted(out)
