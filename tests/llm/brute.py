"""Plain versions of what the operators compute, for small tables."""

import hashlib
import re

import numpy as np
import xxhash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(rows, most=2):
    """(doc_id, signed fingerprint, smallest doc_id reachable) of rows with a doc_id."""
    ids = sorted({r.doc_id for r in rows if r.doc_id is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fp = [(r.doc_id, fingerprint(r.text)) for r in rows if r.doc_id is not None]
    for a, x in fp:
        for b, y in fp:
            if bin(x ^ y).count("1") <= most:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [(i, int(np.uint64(x).view(np.int64)), find(i)) for i, x in fp]


def repeated(docs, width=50):
    """(has id, doc_id, bytes, removed, runs, digest of the rest): bytes covered by strings that start in smaller documents."""
    first = {}
    for i, b in docs:
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            first[s] = min(first.get(s, (i is not None, i or 0)), (i is not None, i or 0))
    for i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < (i is not None, i or 0):
                gone[k : k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        yield (i is not None, i or 0, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())


def similar(a, b):
    """Jaccard similarity of the five-word shingles."""
    x, y = (({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()) for w in ((t or "").lower().split() for t in (a, b)))
    return len(x & y) / len(x | y) if x | y else 1.0
