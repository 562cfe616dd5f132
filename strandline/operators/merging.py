"""Merges of neighbouring pieces, kept up by what changes.

``NumberedWords`` holds the words of a shard as one array of numbers of pieces. A round of merges is a few passes of
numpy over it, and says by how much the counts of pairs change. Its state is four bytes a piece, so it is cheap to store.

``Shard`` does the same by text, word by word, with an inverted index from a pair of neighbours to the words that have
it, and counts triples, which is where two pairs overlap: the plain form, which tests hold the arrays against.
"""

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence

import numpy as np
import xxhash

from strandline.constants import CONTINUATION

type Pair = tuple[str, str]
type Triple = tuple[str | None, str, str]


def joined(left: str, right: str) -> str:
    return left + right.removeprefix(CONTINUATION)


def first_pieces(word: str) -> list[str]:
    return [*word[:1], *[CONTINUATION + letter for letter in word[1:]]]


def merge_pieces(pieces: Sequence[str], pairs: set[Pair]) -> list[str]:
    """Join the pairs from left to right; what was just joined is not joined again."""
    done: list[str] = []
    fresh = False
    for piece in pieces:
        if done and not fresh and (done[-1], piece) in pairs:
            done[-1] = joined(done[-1], piece)
            fresh = True
        else:
            done.append(piece)
            fresh = False
    return done


def triples(pieces: Sequence[str]) -> Iterable[Triple]:
    """(before, left, right) for every pair of neighbours; nothing stands before the first."""
    return zip([None, *pieces], pieces, pieces[1:])


def _key(pair: Pair) -> int:
    """Different pairs may share a key: then words are looked at in vain, and left alone."""
    return xxhash.xxh64_intdigest(f"{pair[0]} {pair[1]}")


class Shard:
    """Words with more than one piece, their frequencies, and where each pair stands."""

    def __init__(self, words: list[str], freqs: list[int]):
        self.words = [" ".join(first_pieces(word)) for word in words]  # pieces have no spaces
        self.freqs = np.array(freqs, np.int64)
        entries = [(_key(pair), number) for number, word in enumerate(self.words) for pair in _pairs(word)]
        self.keys = np.array([key for key, _ in entries], np.uint64)
        self.places = np.array([number for _, number in entries], np.int32)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.places = self.keys[order], self.places[order]
        self.touched = 0  # how many words merges have read

    def counts(self) -> Counter[Triple]:
        found: Counter[Triple] = Counter()
        for word, freq in zip(self.words, self.freqs.tolist()):
            for triple in triples(word.split(" ")):
                found[triple] += freq
        return found

    def having(self, pairs: Iterable[Pair]) -> list[int]:
        """The words in which one of the pairs stands, or stood once."""
        keys = np.array(sorted(map(_key, pairs)), np.uint64)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        found = [self.places[a:b] for a, b in zip(low.tolist(), high.tolist()) if b > a]
        return np.unique(np.concatenate(found)).tolist() if found else []

    def merge(self, pairs: set[Pair]) -> Counter[Triple]:
        """Join the pairs wherever they stand; the changes of the counts of triples."""
        changes: Counter[Triple] = Counter()
        new: list[tuple[int, int]] = []
        for number in self.having(pairs):
            old = self.words[number].split(" ")
            now = merge_pieces(old, pairs)
            self.touched += 1
            if len(now) == len(old):
                continue
            freq = int(self.freqs[number])
            for triple in triples(old):
                changes[triple] -= freq
            for triple in triples(now):
                changes[triple] += freq
            had = set(zip(old, old[1:]))
            new += [(_key(pair), number) for pair in set(zip(now, now[1:])) - had]
            self.words[number] = " ".join(now)
        if new:
            new.sort()
            keys = np.array([key for key, _ in new], np.uint64)
            at = np.searchsorted(self.keys, keys)
            self.keys = np.insert(self.keys, at, keys)
            self.places = np.insert(self.places, at, [number for _, number in new])
        return Counter({triple: n for triple, n in changes.items() if n})

    def pieces_left(self) -> int:
        """Pieces of the words that are not whole."""
        return sum(n + 1 for word in self.words if (n := word.count(" ")) > 0)


#: Numbers of pieces: a first letter is its code point, a letter inside a word so much more, and merged pieces follow.
_INSIDE, _MERGED = 0x110000, 0x220000
#: Stands behind every word.
_END = -1


class PieceNumbers:
    """Texts of pieces and their numbers; equal texts have one number, however they were made."""

    def __init__(self):
        self.merged: list[str] = []
        self.numbers: dict[str, int] = {}

    def text(self, number: int) -> str:
        if number < _INSIDE:
            return chr(number)
        return CONTINUATION + chr(number - _INSIDE) if number < _MERGED else self.merged[number - _MERGED]

    def number(self, text: str) -> int:
        if len(text) == 1:
            return ord(text)
        if len(text) == 1 + len(CONTINUATION) and text.startswith(CONTINUATION):
            return _INSIDE + ord(text[-1])
        if text not in self.numbers:
            self.numbers[text] = _MERGED + len(self.merged)
            self.merged.append(text)
        return self.numbers[text]


def pair_key(left, right):
    """Two numbers of pieces as one."""
    return (left << 32) | right


class NumberedWords:
    """Words of two pieces or more, one after the other, each with an end mark, and their frequencies."""

    def __init__(self, pieces: np.ndarray, freqs: np.ndarray):
        self.pieces, self.freqs = pieces, freqs

    @classmethod
    def of(cls, words: list[str], freqs: Sequence[int]) -> "NumberedWords":
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes) - sizes
        pieces = letters + _INSIDE
        pieces[first] = letters[first]
        found = cls(np.insert(pieces, first + sizes, _END), np.asarray(freqs, np.int64))
        return cls(*found._of_two_or_more())

    def _of_two_or_more(self) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(self.pieces == _END)
        sizes = np.diff(ends, prepend=-1)
        keep = sizes > 2
        return self.pieces[np.repeat(keep, sizes)], self.freqs[keep]

    def _keys(self, pieces: np.ndarray) -> np.ndarray:
        """The pair that begins at each place but the last, -1 where a word ends."""
        keys = pair_key(pieces[:-1].astype(np.int64), pieces[1:].astype(np.int64))
        keys[(pieces[:-1] == _END) | (pieces[1:] == _END)] = -1
        return keys

    def _numbers(self, wanted: np.ndarray) -> np.ndarray:
        """For each place the position of its pair among sorted wanted ones, or -1."""
        keys = self._keys(self.pieces)
        found = np.full(len(keys), -1, np.int64)
        if len(wanted) and len(keys):
            left, right = (np.zeros(int(max(part.max(), self.pieces.max())) + 2, bool) for part in (wanted >> 32, wanted & 0xFFFFFFFF))
            left[wanted >> 32] = right[wanted & 0xFFFFFFFF] = True  # nothing is wanted at -1, the last one
            maybe = np.flatnonzero(left[self.pieces[:-1]] & right[self.pieces[1:]])
            at = np.minimum(np.searchsorted(wanted, keys[maybe]), len(wanted) - 1)
            same = wanted[at] == keys[maybe]
            found[maybe[same]] = at[same]
        return found

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, how often each occurs)."""
        return _sums([self._keyed(self.pieces, self.freqs)])

    def _keyed(self, pieces: np.ndarray, freqs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self._keys(pieces)
        word = np.cumsum(pieces == _END)[:-1]
        inside = keys >= 0
        return keys[inside], freqs[word[inside]]

    def beaten(self, ranked: np.ndarray) -> np.ndarray:
        """Of pairs, the best first, the places in that list of those that overlap with a better one somewhere."""
        order = np.argsort(ranked)
        place = np.append(order, -1)[self._numbers(ranked[order])]
        a, b = place[:-1], place[1:]
        overlap = (a >= 0) & (b >= 0) & (a != b)
        return np.unique(np.maximum(a[overlap], b[overlap]))

    def merge(self, pairs: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join sorted pairs from left to right wherever they stand: (pairs, by how much their counts change)."""
        number = self._numbers(pairs)
        hits = np.flatnonzero(number >= 0)
        if not len(hits):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        run = np.flatnonzero(np.diff(hits, prepend=-2) > 1)  # of a a a the first two are joined
        hits = hits[(np.arange(len(hits)) - np.repeat(run, np.diff(run, append=len(hits)))) % 2 == 0]
        ends = self.pieces == _END
        word = np.cumsum(ends) - ends
        touched = np.zeros(len(self.freqs), bool)
        touched[word[hits]] = True
        stays = np.ones(len(self.pieces), bool)
        stays[hits + 1] = False
        now = self.pieces.copy()
        now[hits] = new[number[hits]]
        now, inside = now[stays], touched[word]
        freqs = self.freqs[touched]
        keys, before = self._keyed(self.pieces[inside], freqs)
        changes = _sums([(keys, -before), self._keyed(now[inside[stays]], freqs)])
        self.pieces = now
        self.pieces, self.freqs = self._of_two_or_more()
        return changes

    def pieces_left(self) -> int:
        return len(self.pieces) - len(self.freqs)

    def words(self) -> list[list[int]]:
        ends = np.flatnonzero(self.pieces == _END)
        return [word[:-1].tolist() for word in np.split(self.pieces, ends[:-1] + 1)] if len(ends) else []


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key that are not zero."""
    keys, values = (np.concatenate(part) for part in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1) != 0)
    sums = np.add.reduceat(values, first) if len(first) else values
    return keys[first][sums != 0], sums[sums != 0]


def _pairs(word: str) -> set[Pair]:
    pieces = word.split(" ")
    return set(zip(pieces, pieces[1:]))


def finish(words: list[list[str]], freqs: list[int], made: dict[str, int], room: int, bar: int) -> list[tuple[str, int]]:
    """Merge the most frequent pair, ties to the smaller one, until none reaches the bar: (piece, count) as they come.

    ``made`` has the pieces so far; once there are ``room`` of them the bar is the count of the last one inside. A heap
    has the pairs by count, with entries that are out of date passed over; the index says which words to rewrite.
    """
    if room <= 0:
        return []
    counts: Counter[Pair] = Counter()
    where: dict[Pair, set[int]] = defaultdict(set)
    for number, (pieces, freq) in enumerate(zip(words, freqs)):
        for pair in zip(pieces, pieces[1:]):
            counts[pair] += freq
            where[pair].add(number)
    heap = [(-n, pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    made, inside = set(made), heapq.nsmallest(room, (-n for n in made.values()))
    inside = [-n for n in inside]
    heapq.heapify(inside)  # counts of the pieces inside, the smallest first
    result: list[tuple[str, int]] = []
    while heap:
        if len(inside) >= room:
            bar = max(bar, inside[0])
        n, pair = heapq.heappop(heap)
        if -n < bar:
            break
        if counts[pair] != -n:
            continue
        piece = joined(*pair)
        if piece not in made:
            made.add(piece)
            result.append((piece, -n))
            (heapq.heappush if len(inside) < room else heapq.heappushpop)(inside, -n)
        changed: set[Pair] = set()
        for number in where.pop(pair):
            old, freq = words[number], freqs[number]
            now = merge_pieces(old, {pair})
            words[number] = now
            gone, come = list(zip(old, old[1:])), list(zip(now, now[1:]))
            while gone and come and gone[-1] == come[-1]:  # what follows the last merge stays as it was
                gone.pop()
                come.pop()
            for other in gone:
                counts[other] -= freq
            for other in come:
                counts[other] += freq
                where[other].add(number)
            changed.update(gone, come)
        for other in changed:
            if counts[other] >= bar and other != pair:
                heapq.heappush(heap, (-counts[other], other))
    return result
