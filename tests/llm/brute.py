"""Plain forms of the operators, for small tables."""

import hashlib
import itertools
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs):
    fps = {i: fingerprint(t) for i, t in docs}
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    comp = components(fps, near)
    return {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def vectors(rows, threshold=0.95):
    x = {}
    for i, v in rows:
        a = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
        if len(a) and np.isfinite(a).all() and a.any():
            x.setdefault(i, a / np.linalg.norm(a))
    links = [(a, b) for a, b in itertools.combinations(x, 2) if len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold]
    comp = components([i for i, _ in rows], links)
    n = {i: sum(i in p for p in links) for i, _ in rows}
    return {i: (n[i], comp[i], i == comp[i]) for i, _ in rows}


def repeats(docs, length=13):
    first, words = {}, {i: WORD.findall(t or "") for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def tiles(item, doc, least):
    """Greedy string tiling as first described: the longest unmarked match, again and again."""
    used_a, used_b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and not used_a[p + n] and not used_b[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return out
        used_a[p : p + n] = used_b[q : q + n] = [True] * n
        out.append((p, q, n))
