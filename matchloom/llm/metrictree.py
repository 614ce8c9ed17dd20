"""Metric trees of integer points by the anchors hierarchy, and nearest entries of a codebook through them.

A tree is built middle-out: about sqrt(n) anchors each own the points nearest to them, the anchors' balls are joined in
pairs up to the root, and the points of each anchor are split further in the same way. Every ball caches the sum and the
number of its points. Entries are assigned level by level: a ball takes over its parent's candidates and drops those that
are farther from all of its points than another one; when one candidate is left, the ball is its own as a whole."""

from __future__ import annotations

import pickle
from math import ceil, sqrt

import numpy as np

#: Balls of so many distinct points are not split.
LEAF = 40


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1).astype(np.float64))


def anchors(points: np.ndarray) -> list[np.ndarray]:
    """The indexes of the points of each anchor; a new anchor is the point farthest from its own and takes what is nearer to it."""
    pivots, owner, dist = [0], np.zeros(len(points), np.int64), norms(points - points[0])
    while len(pivots) < ceil(sqrt(len(points))):
        far = int(dist.argmax())
        if not dist[far]:
            break
        # A point within half the way between the two anchors stays where it is.
        between = norms(points[pivots] - points[far])
        near = np.flatnonzero(dist > between[owner] / 2)
        new = norms(points[near] - points[far])
        win = new < dist[near]
        owner[near[win]], dist[near[win]] = len(pivots), new[win]
        pivots.append(far)
    return [g for i in range(len(pivots)) if len(g := np.flatnonzero(owner == i))]


def grow(points: np.ndarray, ids: np.ndarray, leaf: int) -> tuple:
    """(ids of a leaf,) or (left, right)."""
    if len(ids) <= leaf or len(groups := anchors(points[ids])) == 1:
        return (ids,)
    groups = [ids[g] for g in groups]
    balls: list[tuple | None] = [grow(points, g, leaf) for g in groups]
    size = np.array([len(g) for g in groups], np.float64)
    pivot = np.array([points[g].mean(0) for g in groups])
    radius = np.array([norms(points[g] - c).max() for g, c in zip(groups, pivot)])
    cost = norms(pivot[:, None] - pivot[None]) + radius[:, None] + radius[None]
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(groups) - 1):
        a, b = divmod(int(cost.argmin()), len(groups))
        centre = (pivot[a] * size[a] + pivot[b] * size[b]) / (size[a] + size[b])
        radius[a] = max(norms(pivot[a] - centre) + radius[a], norms(pivot[b] - centre) + radius[b])
        pivot[a], size[a], balls[a], balls[b] = centre, size[a] + size[b], (balls[a], balls[b]), None
        cost[b], cost[:, b] = np.inf, np.inf
        live = np.isfinite(cost[a])
        cost[a, live] = cost[live, a] = (norms(pivot - centre) + radius + radius[a])[live]
        last = a
    return balls[last]


class Tree:
    """points: distinct points in the tree's order; counts: how often each occurs. Balls are ranges of them, the root first."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        distinct, back, counts = np.unique(points.astype(np.int64), axis=0, return_inverse=True, return_counts=True)
        order: list[np.ndarray] = []
        first: list[int] = []
        last: list[int] = []
        left: list[int] = []
        right: list[int] = []
        self._lay(grow(distinct, np.arange(len(distinct)), leaf), order, first, last, left, right, 0)
        at = np.concatenate(order)
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        self.points, self.counts, self.place = distinct[at], counts[at], place[back.ravel()]
        self.first, self.last, self.left, self.right = map(np.array, (first, last, left, right))
        upto = np.zeros((len(at) + 1, points.shape[1] + 1), np.int64)
        np.cumsum(np.column_stack([self.points * self.counts[:, None], self.counts]), axis=0, out=upto[1:])
        whole = upto[self.last] - upto[self.first]
        self.sums, self.total = whole[:, :-1], whole[:, -1]
        self.pivot = self.sums // self.total[:, None]
        self.radius = np.array([norms(self.points[a:b] - p).max() for a, b, p in zip(first, last, self.pivot)])

    def _lay(self, ball, order, first, last, left, right, begin: int) -> int:
        """Lays the ball out from place begin on; returns its number."""
        me = len(first)
        first.append(begin)
        for x in (last, left, right):
            x.append(-1)
        if len(ball) == 1:
            order.append(ball[0])
            last[me] = begin + len(ball[0])
        else:
            left[me] = self._lay(ball[0], order, first, last, left, right, begin)
            right[me] = self._lay(ball[1], order, first, last, left, right, last[left[me]])
            last[me] = last[right[me]]
        return me

    def packed(self) -> bytes:
        state = {k: v.astype(np.min_scalar_type(-int(np.abs(v).max()) - 1)) if k in ("points", "place", "pivot") else v for k, v in self.__dict__.items()}
        return pickle.dumps(state, protocol=5)

    @classmethod
    def unpacked(cls, raw: bytes) -> "Tree":
        tree = cls.__new__(cls)
        tree.__dict__.update({k: v.astype(np.int64) if v.dtype.kind == "i" else v for k, v in pickle.loads(raw).items()})
        return tree

    def owners(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls that belong to one entry as a whole and that entry; the other points and the entry of each (ties: the lower)."""
        index = np.sort(np.unique(entries, axis=0, return_index=True)[1])  # of equal entries the first
        book = entries[index]
        ball, mask = np.array([0]), np.ones((1, len(book)), bool)
        whole, entry, rest, held = [], [], [], []
        while len(ball):
            d = np.where(mask, norms(self.pivot[ball][:, None] - book[None]), np.inf)
            reach = d.min(1, keepdims=True) + 2 * self.radius[ball][:, None]
            mask &= d <= reach + 1e-9 * reach + 1e-6
            own = mask.sum(1) == 1
            whole.append(ball[own])
            entry.append(mask[own].argmax(1))
            end = ~own & (self.left[ball] < 0)
            rest.append(ball[end])
            held.append(mask[end])
            inner = ~own & ~end
            ball, mask = np.concatenate([self.left[ball[inner]], self.right[ball[inner]]]), np.concatenate([mask[inner]] * 2)
        leaves, held = np.concatenate(rest), np.concatenate(held)
        points = np.concatenate([np.arange(self.first[b], self.last[b]) for b in leaves]) if len(leaves) else np.zeros(0, np.int64)
        held = np.repeat(held, self.last[leaves] - self.first[leaves], axis=0)
        diff = self.points[points][:, None] - book[None]
        nearest = np.where(held, (diff * diff).sum(-1), np.iinfo(np.int64).max).argmin(1) if len(points) else points
        return np.concatenate(whole), index[np.concatenate(entry)], points, index[nearest]

    def add_to(self, entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Adds the points of each entry to its sums and counts; balls of one entry by what they have cached."""
        ball, own, points, entry = self.owners(entries)
        np.add.at(sums, own, self.sums[ball])
        np.add.at(counts, own, self.total[ball])
        np.add.at(sums, entry, self.points[points] * self.counts[points, None])
        np.add.at(counts, entry, self.counts[points])

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of every point that was given, and the squared distance to it."""
        ball, own, points, entry = self.owners(entries)
        out = np.empty(len(self.points), np.int64)
        out[points] = entry
        for b, e in zip(ball, own):
            out[self.first[b] : self.last[b]] = e
        diff = self.points - entries[out]
        return out[self.place], (diff * diff).sum(1)[self.place]
