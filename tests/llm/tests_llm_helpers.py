"""Brute-force versions that several tests compare with."""

from __future__ import annotations

import numpy as np
import xxhash


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    out = 0
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hashes) > len(hashes):
            out |= 1 << b
    return out - (out >> 63 << 64)


def brute_components(pairs, tau):
    """Smallest id reachable, by trying all pairs of fingerprints."""
    fps = np.array(sorted({f for _, f in pairs}), np.int64)
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= tau
    root = np.arange(len(fps))
    while True:
        new = np.array([root[near[k]].min() for k in range(len(fps))])
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = {f: r for f, r in zip(fps.tolist(), root.tolist())}
    ids: dict = {}
    for i, f in pairs:
        if i is not None:
            ids[at[f]] = min(ids.get(at[f], i), i)
    return [ids.get(at[f]) for _, f in pairs]


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def similar(a, b, least=0.8):
    if not a or not b:
        return not a and not b
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both) - 1e-9


def near_groups(texts):
    """The smallest id of each group of texts that are linked at a 5-word Jaccard of 0.8, by trying all pairs."""
    ids, sets = sorted(texts), {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if similar(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}
