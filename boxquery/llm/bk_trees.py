"""BK-trees over 64-bit fingerprints: the children of a node are keyed by their Hamming distance to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 64


class Forest:
    """One tree per shard, built and searched together.

    Fingerprints of a shard stand next to each other; the first is the root. A fingerprint goes down to the child
    at its distance until there is none, and becomes that child. So all below a node stand after it.
    """

    def __init__(self, fingerprints: np.ndarray, shards: np.ndarray):
        self.prints = fingerprints.astype(np.uint64)
        n = len(self.prints)
        new = np.concatenate([[True], shards[1:] != shards[:-1]]) if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        below, at = np.flatnonzero(~new), self.root[~new]
        keys, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(below):
            key = at * (BITS + 1) + self.distance(below, at)
            unique, first, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(unique)
            nodes.append(below[first])
            at = below[first][which]
            rest = at != below
            below, at = below[rest], at[rest]
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.prints[a] ^ self.prints[b]).astype(np.int64)

    def earlier_within(self, radius: int, at_once: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (fingerprint, earlier one of its shard) at most radius apart, by following only edges within the radius."""
        n = len(self.prints)
        size = np.bincount(self.root, minlength=n)[self.root]
        start = 0
        while start < n:
            step = max(1, int(np.searchsorted(np.cumsum(size[start : start + at_once]), at_once)))
            queries = np.arange(start, min(n, start + step))
            start += step
            queries = queries[self.root[queries] != queries]
            nodes = self.root[queries]
            while len(queries):
                apart = self.distance(queries, nodes)
                near = apart <= radius
                if near.any():
                    yield queries[near], nodes[near]
                low = np.searchsorted(self.keys, nodes * (BITS + 1) + np.maximum(apart - radius, 0))
                high = np.searchsorted(self.keys, nodes * (BITS + 1) + np.minimum(apart + radius, BITS), side="right")
                sizes = high - low
                within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                nodes = self.nodes[np.repeat(low, sizes) + within]
                queries = np.repeat(queries, sizes)
                before = nodes < queries
                queries, nodes = queries[before], nodes[before]
