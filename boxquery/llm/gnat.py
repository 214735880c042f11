"""A tree of split points for exact range searches (GNAT): multiway hyperplane splits with distance ranges of siblings.

A node has several split points; a vector goes to the child of the nearest one. For every split point the node knows
the range of its distances to the vectors of each child. A search asks for vectors whose inner product with the query
lies in one of several windows, which is an annulus of distances around the query. A child is left out if for some
split point its range and the distances that the annulus allows do not meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLACK = 1e-7  # of the distances that are compared, far above their rounding
AT_ONCE = 256  # queries that go down the tree together


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, squares(x)[:, None] + squares(points) - 2.0 * (x @ points.T)))


class Tree:
    """points[k]: split points of node k; children[k]: their nodes, or leaves as -1 - leaf. Without nodes all is leaf 0."""

    def __init__(self, sample: np.ndarray, rows_each: float, degree: int, leaf_rows: int, most_leaves: int):
        """rows_each: rows of the table to one of the sample. Nodes are split until leaves are small or many."""
        self.points: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        self.leaves = 1
        rng = np.random.default_rng(29)
        waiting = [(sample, None)]
        while waiting:
            rows, place = waiting.pop(0)  # level by level, so that a full tree is even
            points = None
            if len(rows) * rows_each > leaf_rows and self.leaves + degree <= most_leaves:
                points = _apart(rows[rng.choice(len(rows), min(len(rows), 3 * degree), replace=False)], degree)
            if points is None or len(points) < 2:
                continue
            node = len(self.points)
            if place is not None:
                leaf = -1 - self.children[place[0]][place[1]]
                self.children[place[0]][place[1]] = node
            else:
                leaf = 0
            # the first child takes the leaf's number over, the others get new ones
            own = np.array([leaf, *range(self.leaves, self.leaves + len(points) - 1)])
            self.leaves += len(points) - 1
            self.points.append(points)
            self.children.append(-1 - own)
            near = distances(rows, points).argmin(1)
            waiting.extend((rows[near == j], (node, j)) for j in range(len(points)))
        self.ranges: list[tuple] | None = None

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows, distances, nearest) of every node that rows of x come to, nodes above before those below."""
        at = np.zeros(len(x), np.int64)
        for node, points in enumerate(self.points):
            rows = np.flatnonzero(at == node) if node else np.arange(len(x))
            if len(rows):
                apart = distances(x[rows], points)
                near = apart.argmin(1)
                at[rows] = self.children[node][near]
                yield node, rows, apart, near
        self.last = -1 - at

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        if not self.points:
            return np.zeros(len(x), np.int64)
        for _ in self.route(x):
            pass
        return self.last

    def measured(self, x: np.ndarray) -> Iterator[tuple[int, int, int, float, float, float, float]]:
        """(node, point, child, least and most distance, least and most squared length) of these rows."""
        lengths = squares(x)
        for node, rows, apart, near in self.route(x):
            for j in np.unique(near):
                those, length = apart[near == j], lengths[rows[near == j]]
                for i in range(apart.shape[1]):
                    yield node, i, int(j), float(those[:, i].min()), float(those[:, i].max()), float(length.min()), float(length.max())

    def know(self, measured: list[tuple]) -> None:
        """Take the ranges over all rows; a child that no row went to has none."""
        self.ranges = []
        for points in self.points:
            m = len(points)
            self.ranges.append((np.full((m, m), np.inf), np.full((m, m), -np.inf), np.full(m, np.inf), np.full(m, -np.inf)))
        for node, i, j, least, most, short, long in measured:
            low, high, shortest, longest = self.ranges[node]
            low[i, j], high[i, j], shortest[j], longest[j] = least, most, short, long

    def visits(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which leaves (queries x leaves) can hold a vector whose inner product lies in a window [low, high] of the query.

        low and high are queries x windows; a window whose low is above its high is empty.
        """
        out = np.zeros((len(x), self.leaves), bool)
        for start in range(0, len(x), AT_ONCE):
            part = slice(start, start + AT_ONCE)
            out[part] = self._visits(x[part], low[part], high[part])
        return out

    def _visits(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        found = np.zeros((len(x), self.leaves), bool)
        open_ = (low <= high).any(1)
        if not self.points:
            found[:, 0] = open_
            return found
        active = np.zeros((len(x), len(self.points)), bool)
        active[:, 0] = open_
        length = squares(x)
        for node, points in enumerate(self.points):
            rows = np.flatnonzero(active[:, node])
            if not len(rows):
                continue
            apart = distances(x[rows], points)[:, None, :, None]  # queries x windows x points x children
            least, most, short, long = self.ranges[node]
            lo, hi = low[rows][:, :, None], high[rows][:, :, None]
            own = length[rows][:, None, None]
            # the annulus of each window around the query, for the lengths that a child has
            with np.errstate(invalid="ignore", over="ignore"):
                inner = np.sqrt(np.maximum(0.0, own + short - 2.0 * hi))[:, :, None, :]
                outer = np.sqrt(np.maximum(-1.0, own + long - 2.0 * lo))[:, :, None, :]
                slack = SLACK * (1.0 + apart + np.where(np.isfinite(outer), outer, 0.0))
                missed = (np.maximum(apart - outer, inner - apart) > most + slack) | (apart + outer < least - slack)
                empty = (lo > hi) | ~(short <= long) | (own + long - 2.0 * lo < 0)
            near = (~missed.any(2) & ~empty).any(1)
            for j, child in enumerate(self.children[node]):
                reached = rows[near[:, j]]
                if child >= 0:
                    active[reached, child] = True
                else:
                    found[reached, -1 - child] = True
        return found


def _apart(candidates: np.ndarray, degree: int) -> np.ndarray:
    """Up to so many different candidates, each far from those before it."""
    taken = [0]
    nearest = distances(candidates, candidates[:1])[:, 0]
    while len(taken) < degree and nearest.max() > 0:
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(candidates, candidates[taken[-1:]])[:, 0])
        nearest[taken[-1]] = 0.0
    return candidates[taken]
