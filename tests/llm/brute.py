"""Plain versions of operators, for small inputs."""

import hashlib
import re
from collections import Counter


def near(docs, width, percent=80):
    """doc_id: (set size, smallest doc_id reachable), counting shared shingles by an inverted list."""
    sets, where, parent = {}, {}, {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        parent[d] = d
        for x in sets[d]:
            where.setdefault(x, []).append(d)

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, both in Counter(e for x in s for e in where[x] if e != d).items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = sorted((top(d), top(e)))
                parent[b] = a
    return {d: (len(s), top(d)) for d, s in sets.items()}


def repeats(docs, length=100):
    """doc_id: (bytes, bytes removed, runs removed, digest of the rest)."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out
