"""Suffix arrays over the words of a shard of documents, searched for every suffix of a set of test items."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np

# Lower-case ASCII letters, digits, and all bytes of non-ASCII characters.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words_of(text: bytes) -> list[bytes]:
    return _WORDS(text.lower())


class TestItems:
    """Items as word numbers. Equal items are one sequence with several ids; items without words are left out.

    A suffix is a word position of a sequence. `need` is the number of words its window has: `window`, or all
    words of a shorter item at its first word; 0 where fewer words than a window are left.
    """

    __test__ = False  # not a test class for pytest

    def __init__(self, items: Iterable[tuple[int | None, str | None]], window: int):
        sequences: dict[tuple[bytes, ...], set[int]] = {}
        for item_id, text in items:
            words = tuple(words_of((text or "").encode()))
            if words:
                ids = sequences.setdefault(words, set())
                if item_id is not None:
                    ids.add(item_id)
        self.ids = [sorted(ids) for ids in sequences.values()]
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        self.longest = int(lengths.max(initial=0))
        self.sequence = np.repeat(np.arange(len(lengths)), lengths)
        self.start = np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else np.zeros(0, np.int64)
        self.left = np.repeat(lengths, lengths) - self.start
        whole = np.repeat(np.minimum(lengths, window), lengths)
        self.need = np.where(self.left >= whole, whole, 0)
        self.words = np.array([self.vocabulary[w] for s in sequences for w in s] + [0] * (self.longest + 64), dtype=np.int64)


class Shard:
    """The suffix array of the words of some texts.

    Words that no test item has are number 0, and so is the place after each text. A suffix that starts with 0
    can match nothing and is not in the array; what follows a 0 cannot be part of a match and is not compared.
    Suffixes are sorted by as many words as fit into one integer, then the ones still equal by doubled lengths
    up to the longest test item.
    """

    def __init__(self, texts: Iterable[bytes], items: TestItems):
        get, zero = items.vocabulary.get, repeat(0)
        parts, counts = [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            parts.append(np.fromiter(map(get, words, zero), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
        self.counts = np.array(counts, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts + 1)])
        size, depth = int(self.first[-1]), max(items.longest, 1)
        self.pack = max(1, min(depth, 63 // items.bits))
        self.bits = items.bits
        self.words = np.concatenate([*parts, np.zeros(2 * depth + self.pack, np.int64)])
        self.size = size
        self._sort(depth)

    def _sort(self, depth: int) -> None:
        words, size = self.words, self.size
        stops = np.where(words == 0, np.arange(len(words)), len(words))
        run = np.minimum.accumulate(stops[::-1])[::-1] - np.arange(len(words))  # known words from here on
        starts = np.flatnonzero(words[:size])
        keys, known = np.zeros(len(starts), np.int64), run[starts]
        for j in range(self.pack):
            keys = (keys << self.bits) | np.where(known > j, words[starts + j], 0)
        by_key = np.argsort(keys)
        self.order, self.keys = starts[by_key], keys[by_key]
        if depth <= self.pack or not len(starts):
            return
        new = np.concatenate([[True], self.keys[1:] != self.keys[:-1]])
        group = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        rank = np.zeros(len(words), np.int64)
        rank[self.order] = group + 1
        last = np.concatenate([new[1:], [True]])
        tied = np.flatnonzero(~(new & last) & (run[self.order] >= self.pack))
        length = self.pack
        while length < depth and len(tied):
            places = self.order[tied]
            head, tail = rank[places], rank[places + length]
            sort = np.lexsort((tail, head))
            places, head, tail = places[sort], head[sort], tail[sort]
            self.order[tied] = places
            new = np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
            rank[places] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
            last = np.concatenate([new[1:], [True]])
            length *= 2
            tied = tied[~(new & last) & (run[places] >= length)]

    def search(self, items: TestItems) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per test suffix: the length of its longest match, its places (from, to) in the array, and the places at the length it needs."""
        n, top = len(items.start), len(self.order)
        length, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        need_low, need_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        active = np.arange(n) if top else np.zeros(0, np.int64)
        lo, hi = np.zeros(len(active), np.int64), np.full(len(active), top)
        prefix, depth = np.zeros(len(active), np.int64), 0
        while len(active):
            more = items.left[active] > depth
            active, lo, hi, prefix = active[more], lo[more], hi[more], prefix[more]
            word = items.words[active + depth]
            if depth < self.pack:
                prefix = (prefix << self.bits) | word
                rest = self.bits * (self.pack - depth - 1)
                lo = np.searchsorted(self.keys, prefix << rest)
                hi = np.searchsorted(self.keys, ((prefix + 1) << rest) - 1, side="right")
            else:
                lo, hi = self._bound(lo, hi, depth, word, False), self._bound(lo, hi, depth, word, True)
            found = lo < hi
            active, lo, hi, prefix = active[found], lo[found], hi[found], prefix[found]
            depth += 1
            length[active], low[active], high[active] = depth, lo, hi
            full = items.need[active] == depth
            need_low[active[full]], need_high[active[full]] = lo[full], hi[full]
        return length, low, high, need_low, need_high

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, after: bool) -> np.ndarray:
        """Binary search in each range of suffixes for the first whose next word is not below (or is above) the wanted one."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) // 2
            there = self.words[self.order[middle] + depth]
            below = there <= word[open_] if after else there < word[open_]
            lo[open_[below]] = middle[below] + 1
            hi[open_[~below]] = middle[~below]
        return lo

    def text_at(self, places: np.ndarray) -> np.ndarray:
        """Which text each place is in."""
        return np.searchsorted(self.first, places, side="right") - 1


def places_of(order: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the given ranges of the array, and for each the number of its range."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order[low[which] + within], which
