"""Weighted MinHash signatures by hashed darts.

An element of weight w owns the strips [0, 1), [1, 2), ... up to w. On every strip the same darts fall for all documents:
their ranks are the arrivals of a unit Poisson process, each with a hashed coordinate and a place in the strip. A
document keeps the darts inside its elements' weights with a rank below a limit that gives it t darts on average,
whatever its size, and of those the earliest per coordinate. Two documents agree on a coordinate with
probability equal to their weighted Jaccard similarity. If a coordinate gets no dart the limit is doubled.
"""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strips(doc: np.ndarray, element: np.ndarray) -> np.ndarray:
    """A hash for each occurrence: of its element and of how many came before it in the document (doc is sorted)."""
    order = np.lexsort((element, doc))
    d, e = doc[order], element[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (e[1:] != e[:-1])]) if len(d) else np.zeros(0, bool)
    at = np.arange(len(d))
    before = at - np.maximum.accumulate(np.where(new, at, 0)) if len(d) else at
    out = np.empty(len(d), np.uint64)
    out[order] = mix(e + mix(before.astype(np.uint64) + np.uint64(1)))
    return out


def throw(strip: np.ndarray, doc: np.ndarray, limit: np.ndarray, k: int, inside: np.ndarray | None = None):
    """All darts on the strips with a rank below their document's limit: (document, coordinate, rank, dart).

    inside: how much of its strip each element covers; darts beyond fall outside."""
    docs, coordinates, ranks, darts = [], [], [], []
    live, rank, i = np.arange(len(strip)), np.zeros(len(strip)), 0
    while len(live):
        # Several darts a strip at a time where few strips are left; the sums are the same as one by one.
        n = max(1, min(256, (1 << 14) // len(live)))
        x = mix(strip[live, None] + GOLDEN * np.arange(i + 1, i + n + 1, dtype=np.uint64))
        steps = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        steps[:, 0] += rank
        arrival = np.cumsum(steps, axis=1)
        near = arrival < limit[doc[live], None]
        row, _ = np.nonzero(near)
        x, own = x[near], live[row]
        dart = mix(x + GOLDEN)
        keep = slice(None) if inside is None else (mix(dart + GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < inside[own]
        docs.append(doc[own][keep])
        coordinates.append((dart[keep] % np.uint64(k)).astype(np.int64))
        ranks.append(arrival[near][keep])
        darts.append(dart[keep])
        more = near[:, -1]
        live, rank, i = live[more], arrival[more, -1], i + n
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (docs, coordinates, ranks, darts))


def signatures(strip: np.ndarray, doc: np.ndarray, n_docs: int, k: int, inside: np.ndarray | None = None, extra: float = 4.0) -> np.ndarray:
    """(n_docs, k) darts; documents are numbered from 0, and those without weight get zeros."""
    out = np.zeros((n_docs, k), np.uint64)
    weight = np.bincount(doc, inside, minlength=n_docs).astype(np.float64)
    todo = np.flatnonzero(weight > 0)
    t = k * (np.log(k) + extra)
    while len(todo):
        limit = np.zeros(n_docs)
        limit[todo] = t / weight[todo]
        here = limit[doc] > 0
        d, c, r, x = throw(strip[here], doc[here], limit, k, None if inside is None else inside[here])
        key = d * k + c
        earliest = np.full(n_docs * k, np.inf)
        np.minimum.at(earliest, key, r)
        first = r == earliest[key]
        got = np.zeros(n_docs * k, np.uint64)
        got[key[first]] = x[first]
        hit = earliest < np.inf
        full = hit.reshape(n_docs, k).all(1)
        done = todo[full[todo]]
        out[done] = got.reshape(n_docs, k)[done]
        todo = todo[~full[todo]]
        t *= 2
    return out


def bands(signature: np.ndarray, rows: int, deals: int = 1) -> np.ndarray:
    """(n_docs, deals * k / rows) hashes of the bands, signed, the band's number included.

    The coordinates are dealt into bands so many times: in order, then in fixed random orders."""
    n, k = signature.shape
    per = k // rows
    out = np.empty((n, deals * per), np.uint64)
    for d in range(deals):
        order = np.random.default_rng(d).permutation(k) if d else np.arange(k)
        for b in range(per):
            h = np.full(n, np.uint64(d * per + b + 1))
            for c in order[b * rows : (b + 1) * rows]:
                h = mix(h * GOLDEN + signature[:, c])
            out[:, d * per + b] = h
    return out.view(np.int64)
