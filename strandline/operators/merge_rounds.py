"""Rounds of merges over shards of words that stay in memory, in one task or in tasks that run at the same time.

``LinkedWords`` holds a shard as arrays in which a piece stays at the place of its first letter, so that a merge changes
what stands around it and nothing else. ``merge_rounds`` agrees on the merges of every round with the other tasks.
"""

import heapq
from collections.abc import Callable

import numpy as np

from strandline.operators.merging import _END, PieceNumbers, _sums, joined, pair_key

#: Stands where the second half of a merged pair began.
_GONE = -2
#: Places that are looked at in one go.
_STRETCH = 1 << 20


class LinkedWords:
    """Words of two pieces or more with an end mark in front and behind, the pair that begins at each place, and the counts of pairs.

    ``sizes`` has at the first and at the last place of a piece how many places it takes.
    """

    def __init__(self, pieces: np.ndarray, freqs: np.ndarray):
        """Pieces as ``NumberedWords`` has them."""
        self.pieces = np.concatenate([np.array([_END], np.int32), pieces.astype(np.int32, copy=False)])
        self.freqs = np.asarray(freqs, np.int64)
        self.keys, self.ids = np.array([-1]), np.zeros(1, np.int32)  # pairs in order, and their numbers; 0 is none
        self.key_of, self.counts = np.array([-1]), np.zeros(1, np.int64)  # by number
        self._place()
        self.pairs = np.zeros(len(self.pieces), np.int32)
        for start in range(0, len(self.pieces) - 1, _STRETCH):
            at = np.arange(start, min(start + _STRETCH, len(self.pieces) - 1))
            self.pairs[at] = self._ids(self._keys(at))
            self.counts += self._counted(at)

    def _place(self) -> None:
        ends = self.pieces == _END
        self.words = np.cumsum(ends, dtype=np.int32) - ends - np.int32(1)
        self.in_word = np.diff(np.flatnonzero(ends)).astype(np.int32) - np.int32(1)
        self.sizes = np.ones(len(self.pieces), np.int32)
        self.touched = np.zeros(len(self.pieces), bool)
        self.left = int(self.in_word[self.in_word > 1].sum())

    def _compact(self) -> None:
        """Leave out what is gone, and words that are whole."""
        stays = self.in_word > 1
        keep = self.pieces != _GONE
        keep[1:] &= stays[self.words[1:]]
        self.pieces, self.pairs, self.freqs = self.pieces[keep], self.pairs[keep], self.freqs[stays]
        self._place()

    def _keys(self, at: np.ndarray) -> np.ndarray:
        left, right = self.pieces[at].astype(np.int64), self.pieces[at + self.sizes[at]].astype(np.int64)
        keys = pair_key(left, right)
        keys[(left == _END) | (right == _END)] = -1
        return keys

    def _ids(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of pairs; new ones get the next."""
        found, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.keys, found)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == found
        ids = np.empty(len(found), np.int32)
        ids[known] = self.ids[at[known]]
        new = ~known
        if new.any():
            ids[new] = np.arange(len(self.counts), len(self.counts) + np.count_nonzero(new))
            self.keys, self.ids = np.insert(self.keys, at[new], found[new]), np.insert(self.ids, at[new], ids[new])
            self.key_of = np.concatenate([self.key_of, found[new]])
            self.counts = np.concatenate([self.counts, np.zeros(np.count_nonzero(new), np.int64)])
        return ids[back]

    def _counted(self, at: np.ndarray) -> np.ndarray:
        """By pair how often it begins at these places."""
        sums = np.bincount(self.pairs[at], self.freqs[self.words[at]], len(self.counts)).astype(np.int64)
        sums[0] = 0
        return sums

    def ids_of(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of pairs, 0 for those that never stood here."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], 0)

    def rank(self, ranked: np.ndarray) -> np.ndarray:
        """Find pairs, the best first: for each whether it overlaps with a better one somewhere."""
        self.places = np.full(len(self.counts), -1, np.int32)
        self.places[self.ids_of(ranked)] = np.arange(len(ranked))
        self.places[0] = -1
        beaten, hits = np.zeros(len(ranked), bool), []
        for start in range(0, len(self.pieces), _STRETCH):
            place = self.places[self.pairs[start : start + _STRETCH]]
            at = np.flatnonzero(place >= 0)
            a, at = place[at], (at + start).astype(np.int32)
            b = self.places[self.pairs[at + self.sizes[at]]]
            overlap = (b >= 0) & (a != b)
            beaten[np.maximum(a[overlap], b[overlap])] = True
            hits.append(at)
        self.hits = np.concatenate(hits)
        return beaten

    def merge(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join ranked pairs from left to right: ``new`` has their new numbers, -1 for those to leave. Returns pairs whose counts changed, and by how much."""
        hits = self.hits[new[self.places[self.pairs[self.hits]]] >= 0].astype(np.int64)
        if not len(hits):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        run = np.flatnonzero(np.append(True, hits[1:] != (hits + self.sizes[hits])[:-1]))  # of a a a the first two are joined
        hits = hits[(np.arange(len(hits)) - np.repeat(run, np.diff(run, append=len(hits)))) % 2 == 0]
        second = hits + self.sizes[hits]
        joint = new[self.places[self.pairs[hits]]]
        gone = self._counted(self._all(self._before(hits), hits, second))
        self.pieces[hits], self.pieces[second], self.pairs[second] = joint, _GONE, 0
        sizes = self.sizes[hits] + self.sizes[second]
        self.sizes[hits] = self.sizes[hits + sizes - 1] = sizes
        at = self._all(self._before(hits), hits)
        self.pairs[at] = self._ids(self._keys(at))
        changes = self._counted(at)
        changes[: len(gone)] -= gone
        self.counts += changes
        words, times = np.unique(self.words[hits], return_counts=True)
        self.in_word[words] -= times.astype(np.int32)
        self.left -= len(hits) + np.count_nonzero(self.in_word[words] == 1)
        if 2 * self.left < len(self.pieces) - len(self.freqs):
            self._compact()
        ids = np.flatnonzero(changes)
        return self.key_of[ids], changes[ids]

    def all_counts(self) -> tuple[np.ndarray, np.ndarray]:
        return self.key_of[1:], self.counts[1:]

    def _before(self, at: np.ndarray) -> np.ndarray:
        return at - self.sizes[at - 1]

    def _all(self, *parts: np.ndarray) -> np.ndarray:
        """Places in order, each once."""
        for part in parts:
            self.touched[part] = True
        at = np.flatnonzero(self.touched)
        self.touched[at] = False
        return at

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and frequencies of the words that are not whole, as ``NumberedWords`` has them."""
        self._compact()
        return self.pieces[1:], self.freqs


class _Totals:
    """Counts of pairs in all shards of all tasks; every task holds the same."""

    def __init__(self):
        self.keys, self.sums = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, changes: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys, sums = _sums(changes)
        if not len(keys):
            return
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        self.sums[at[known]] += sums[known]
        new = ~known
        self.keys, self.sums = np.insert(self.keys, at[new], keys[new]), np.insert(self.sums, at[new], sums[new])

    def best(self, numbers: PieceNumbers, bar: int, limit: int) -> list[tuple[int, int]]:
        """The ``limit`` best pairs of at least ``bar`` occurrences, (pair, n), ties by text."""
        at = np.flatnonzero(self.sums >= bar)
        if len(at) > limit:
            sums = self.sums[at]
            at = at[sums >= np.partition(sums, len(at) - limit)[len(at) - limit]]
        pairs = zip(self.keys[at].tolist(), self.sums[at].tolist())
        ranked = sorted((-n, numbers.text(key >> 32), numbers.text(key & 0xFFFFFFFF), key) for key, n in pairs)
        return [(key, -n) for n, _, _, key in ranked[:limit]]


def merge_rounds(
    shards: list[LinkedWords], gather: Callable, made: dict[str, int], room: int, least: int, limit: int, small: int
) -> bool:
    """Add to ``made`` the pieces that merges make, with their counts, in the order they come; whether no merges are left.

    ``gather`` hands a value of every task to all of them, in the order of tasks. Each round merges every pair that beats
    all pairs it overlaps with, of the ``limit`` best. The rounds stop early when the words that are not whole have at
    most ``small`` pieces.
    """
    numbers, totals = PieceNumbers(), _Totals()
    for piece in made:
        numbers.number(piece)
    bar = risen_bar(made, room, least)
    changes = _sums([shard.all_counts() for shard in shards])
    while True:
        totals.add(gather(changes))
        best = totals.best(numbers, bar, limit)
        if not best:
            return True
        ranked = np.array([key for key, _ in best], np.int64)
        own = np.logical_or.reduce([shard.rank(ranked) for shard in shards])
        told = gather((np.packbits(own), sum(shard.left for shard in shards)))
        if sum(left for _, left in told) <= small:
            return False
        beaten = np.unpackbits(np.bitwise_or.reduce([marks for marks, _ in told]), count=len(best)).astype(bool)
        new = np.full(len(best), -1, np.int32)
        for place in np.flatnonzero(~beaten).tolist():
            key, n = best[place]
            piece = joined(numbers.text(key >> 32), numbers.text(key & 0xFFFFFFFF))
            made.setdefault(piece, n)
            new[place] = numbers.number(piece)
        bar = risen_bar(made, room, least)
        changes = _sums([shard.merge(new) for shard in shards])


def risen_bar(made: dict[str, int], room: int, least: int) -> int:
    """Once there are ``room`` pieces only pairs count that come as often as the last one inside."""
    return max(least, heapq.nlargest(room, made.values())[-1]) if len(made) >= room else least
