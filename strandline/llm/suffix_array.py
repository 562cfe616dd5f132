"""Suffix arrays of byte strings in numpy: order, common prefixes, search.

The order is refined by doubling (Larsson and Sadakane): ranks by the first h bytes give ranks by the first 2h, and only
groups that are still tied are sorted again. Longest common prefixes are Kasai's, taken along many stretches of the
text at once. Sorted windows of two arrays meet by binary search.
"""

import numpy as np

#: Positions and ranks are packed into one word to be sorted, so a text has at most so many places.
MAX_BYTES = 1 << 21
_BITS = np.uint64(21)
_MASK = np.uint64((1 << 21) - 1)
_START = 5
_LANES = 4096
#: Symbols of 9 bits in a word, compared at once.
_WORD = 7


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (small non-negative numbers up to 256) in the order of what follows; ends sort first."""
    n = len(text)
    if n > MAX_BYTES:
        raise ValueError(f"a text has at most {MAX_BYTES} places")
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(_START, np.uint64)])
    first = np.zeros(n, np.uint64)
    for i in range(_START):  # 258 values a place: the end of the text is less than any
        first = first * np.uint64(258) + padded[i : i + n]
    packed = np.sort((first << _BITS) | np.arange(n, dtype=np.uint64))
    order = (packed & _MASK).astype(np.int64)
    rank = np.zeros(n, np.int64)
    tied = _rank(packed >> _BITS, order, rank, np.arange(n))
    h = _START
    while len(tied):
        at = order[tied]
        # a rank is the first place of its group, so refined groups stay inside their places
        later = at + h
        follow = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0).astype(np.uint64)
        key = (rank[at].astype(np.uint64) << np.uint64(22)) | follow
        packed = np.sort((key << _BITS) | np.arange(len(at), dtype=np.uint64))
        order[tied] = at[(packed & _MASK).astype(np.int64)]
        tied = _rank(packed >> _BITS, order[tied], rank, tied)
        h *= 2
    return order


def _rank(keys: np.ndarray, at: np.ndarray, rank: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Sets the ranks of the sorted suffixes ``at`` in the places ``slots``; the places that are still tied."""
    if not len(keys):
        return slots
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
    return slots[~(new & np.concatenate([new[1:], [True]]))]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """``lcp[i]``: places that the suffixes ``order[i - 1]`` and ``order[i]`` share, ``depth`` at most; ``lcp[0]`` is 0.

    Kasai: going on by one place in the text loses at most one place of the prefix shared with the suffix before it in
    the order. The text is cut into stretches that are walked side by side, and compared several symbols at a time.
    """
    n = len(order)
    before = np.zeros(n, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text.astype(np.uint64), np.zeros(depth + 2 * _WORD, np.uint64)])
    words = np.zeros(n + depth + _WORD, np.uint64)
    for i in range(_WORD):
        words = (words << np.uint64(9)) | padded[i : i + len(words)]
    shared = np.zeros(n, np.int64)
    length = max(1, -(-n // _LANES))
    starts = np.arange(0, n, length)
    known = np.zeros(len(starts), np.int64)
    for step in range(length):
        at = starts[starts + step < n] + step
        known = np.maximum(known[: len(at)] - 1, 0)
        other = before[at]
        lanes = np.arange(len(at))
        while len(lanes):
            differ = words[at[lanes] + known[lanes]] ^ words[other[lanes] + known[lanes]]
            known[lanes] += _equal_symbols(differ)
            lanes = lanes[(differ == 0) & (known[lanes] < depth)]
        known = np.minimum(np.minimum(known, depth), n - np.maximum(at, other))
        shared[at] = known
    lcp = shared[order]
    lcp[:1] = 0
    return lcp


def _equal_symbols(differ: np.ndarray) -> np.ndarray:
    """How many leading symbols of two words are equal, given their difference."""
    return sum((differ < np.uint64(1 << (9 * k))).astype(np.int64) for k in range(_WORD))


def windows(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes at each place as rows of big-endian words, padded with zeros."""
    words = -(-size // 8)
    rows = np.zeros((len(at), words * 8), np.uint8)
    if len(at):
        rows[:, :size] = np.lib.stride_tricks.sliding_window_view(text, size)[at]
    return rows.view(">u8").astype(np.uint64)


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    first = differ.argmax(axis=1)
    rows = np.arange(len(a))
    return differ.any(axis=1) & (a[rows, first] < b[rows, first])


def search(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The row of ``ordered`` (sorted, distinct) equal to each row of ``wanted``, or -1: a binary search for all at once."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(ordered), np.int64)
    if not len(ordered):
        return low - 1
    while (low < high).any():
        middle = (low + high) // 2
        after = _less(ordered[np.minimum(middle, len(ordered) - 1)], wanted) & (low < high)
        low, high = np.where(after, middle + 1, low), np.where(after, high, np.minimum(high, middle))
    found = np.minimum(low, len(ordered) - 1)
    return np.where((ordered[found] == wanted).all(axis=1), found, -1)
