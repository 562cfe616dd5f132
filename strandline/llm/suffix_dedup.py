"""Removes every byte of a repeated passage: those covered by a 100-byte string that also starts earlier.

Only text near a repeat is worth sorting. Every 100-byte window has a seed, the 32-byte string in it with the smallest
hash; equal windows have equal seeds at equal places. Windows next to each other mostly share theirs, so a text is a row
of contexts: the stretch of bytes whose windows have one seed in common.

1. Shards count the contexts of their seeds. A context that no other one shares its seed with is settled in its shard:
   all copies but the first are covered.
2. The other contexts go to the bucket of their seed, each once per shard. Equal ones are settled by comparison. Of
   different ones with one seed a suffix array (Larsson-Sadakane) and its common prefixes (Kasai) tell which windows
   are equal; a seed with more contexts than one array holds has several arrays, merged by binary search.
3. Shards cover the windows that are not the first of their kind, and cut out the covered bytes.

A seed with more than ``HOT`` contexts, such as a line that a third of all documents have, would crowd its bucket. Its
windows are sent one by one to the buckets of their own hashes, and compared by 128 bits.

"Earlier" is by ``doc_id``, then by start; a null ``doc_id`` is before all others, and rows that repeat a ``doc_id`` are
not before each other. Null texts count as empty. Texts shorter than a window lose nothing. Other columns are not read.
An empty table gives an empty result.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm import suffix_array as sa
from strandline.llm.sharding import COUNTS, COUNTS_DDL, column_arrays, shard_count, sharded, slices, sum_counts

MATCH = 100
SEED = 32
HOT = 2_000
_SPAN = MATCH - SEED + 1  # seeds in a window
#: Bytes hashed at once; places in a block fit into 20 bits.
_BLOCK = 1_000_000
#: Bytes of contexts in one suffix array.
ARRAY_BYTES = 1_000_000
_PLACE = np.uint64((1 << 20) - 1)
_RANDOM = np.random.default_rng(20240101).integers(1, 1 << 63, (2, 256), np.uint64)
_BASE = 0x9E3779B97F4A7C15
_NULL_ID = np.iinfo(np.int64).min


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


_LENGTH = _BLOCK + MATCH
_UP, _DOWN = _powers(_BASE, _LENGTH + 1), _powers(pow(_BASE, -1, 1 << 64), _LENGTH + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any stretches of a block: prefix sums of a polynomial over random values of the bytes."""

    def __init__(self, data: np.ndarray, table: int):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RANDOM[table][data] * _UP[: len(data)], out=self.sums[1:])

    def of_all(self, size: int) -> np.ndarray:
        """Of the stretch of this size from every place."""
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * _DOWN[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * _DOWN[start])


@dataclass
class Contexts:
    """Contexts of a shard by place: windows start from ``low`` to ``high``; the seed, and a hash of the bytes.

    Inside a shard, some hundred thousand contexts, 64 bits stand for the bytes; buckets compare the bytes.
    """

    low: np.ndarray
    high: np.ndarray
    seed: np.ndarray
    hash: np.ndarray


class Shard:
    """The texts of a shard, end to end."""

    def __init__(self, table: pa.Table):
        texts = [(text or "").encode() for text in table["text"].to_pylist()]
        sizes = np.array([len(text) for text in texts], np.int64)
        self.ids = np.array([_NULL_ID if i is None else i for i in table["doc_id"].to_pylist()], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, ends of the texts): whole short texts together, a long one in stretches cut by its own length."""
        first = 0
        while first < len(self.starts):
            start = int(self.starts[first])
            last = int(np.searchsorted(self.ends, start + _BLOCK, "right"))
            if last > first:
                yield start, int(self.ends[last - 1]), self.ends[first:last]
                first = last
                continue
            end = int(self.ends[first])
            for cut in range(start, end - MATCH + 1, _BLOCK):
                stop = min(end, cut + _BLOCK + MATCH - 1)
                yield cut, stop, np.array([stop])
            first += 1

    def contexts(self) -> Contexts:
        parts = [self._block(*block) for block in self.blocks()]
        if not parts:
            empty = np.empty(0, np.int64)
            return Contexts(empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
        return Contexts(*map(np.concatenate, zip(*parts)))

    def _block(self, start: int, end: int, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        data = self.data[start:end]
        if len(data) < MATCH:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        hashes = Hashes(data, 0)
        seeds = hashes.of_all(SEED)
        least = (seeds & ~_PLACE) | np.arange(len(seeds), dtype=np.uint64)  # of equal seeds the first
        width = 1
        while 2 * width <= _SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(data) - MATCH + 1], least[_SPAN - width :])
        begin = np.arange(len(least))
        begin = begin[begin + MATCH <= np.repeat(ends - start, np.diff(ends - start, prepend=0))[: len(least)]]
        place = (least[begin] & _PLACE).astype(np.int64)
        if not len(begin):
            return begin, begin, begin.astype(np.uint64), begin.astype(np.uint64)
        new = np.flatnonzero((np.diff(place) != 0) | (np.diff(begin) != 1)) + 1
        low, high = begin[np.concatenate([[0], new])], begin[np.concatenate([new - 1, [-1]])]
        # the seeds are small, being the smallest: mixed again they fill the buckets evenly
        chosen = _mixed(seeds[place[np.concatenate([[0], new])]] * np.uint64(_BASE))
        return low + start, high + start, chosen, hashes.of(low, high + MATCH)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place, "right")

    def first(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and start in the document."""
        document = self.document(low)
        return self.ids[document], low - self.starts[document]

    def classes(self, found: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first place of every distinct context in the order of their hashes, the class of each context, and
        whether a context is a first one: several are if a ``doc_id`` is repeated."""
        ids, begins = self.first(found.low)
        order = np.lexsort((begins, ids, found.hash))
        new = np.diff(found.hash[order], prepend=found.hash[order][:1] + np.uint64(1)) != 0
        kind = np.cumsum(new) - 1
        heads = order[new]
        of = np.empty(len(order), np.int64)
        of[order] = kind
        return heads, of, (ids == ids[heads[of]]) & (begins == begins[heads[of]])


def _count_seeds(buckets: int):
    """How many different contexts of the shard have each seed."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        shard = Shard(table)
        found = shard.contexts()
        heads, _, _ = shard.classes(found)
        keys, counts = np.unique(found.seed[heads], return_counts=True)
        rows = [
            {"shard": key[0].as_py(), "n": 0, "bucket": bucket, "keys": keys[a:b].tobytes(),
             "counts": counts[a:b].astype(np.uint32).tobytes()}
            for bucket, a, b in slices(keys, buckets)
        ]
        return pa.Table.from_pylist(rows, COUNTS)

    return count


_ASKED = pa.schema([
    ("shard", pa.int32()), ("bucket", pa.int32()), ("hot", pa.bool_()), ("keys", pa.binary()), ("seeds", pa.binary()),
    ("ids", pa.binary()), ("begins", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary()),
])
_ASKED_DDL = (
    "shard int, bucket int, hot boolean, keys binary, seeds binary, ids binary, begins binary, sizes binary, bytes binary"
)
_TOLD = pa.schema([
    ("shard", pa.int32()), ("hot", pa.bool_()), ("keys", pa.binary()), ("seeds", pa.binary()), ("bits", pa.binary())
])
_TOLD_DDL = "shard int, hot boolean, keys binary, seeds binary, bits binary"


def _ask(buckets: int, hot: int):
    """The distinct contexts that share a seed with another one, or the windows of those with a hot seed."""

    def ask(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        number = key[0].as_py()
        shard = Shard(texts)
        found = shard.contexts()
        heads, _, _ = shard.classes(found)
        seeds = np.unique(found.seed[heads])
        answers = answers.sort_by("bucket")
        totals = np.concatenate([np.empty(0, np.int64), *column_arrays(answers, "totals", np.int64)])
        total = totals[np.searchsorted(seeds, found.seed[heads])]
        rows = []
        shared = heads[(total > 1) & (total <= hot)]
        shared = shared[np.argsort(found.seed[shared], kind="stable")]
        ids, begins = shard.first(found.low[shared])
        for bucket, a, b in slices(found.seed[shared], buckets):
            mine = shared[a:b]
            sizes = found.high[mine] + MATCH - found.low[mine]
            rows.append({
                "shard": number, "bucket": bucket, "hot": False, "keys": found.hash[mine].tobytes(),
                "seeds": found.seed[mine].tobytes(), "ids": ids[a:b].tobytes(), "begins": begins[a:b].tobytes(),
                "sizes": sizes.astype(np.uint16).tobytes(),
                "bytes": b"".join(shard.data[i : i + n].tobytes() for i, n in zip(found.low[mine], sizes)),
            })
        crowded = heads[total > hot]
        windows, keys, more, seeds = _hot_windows(shard, found, crowded)
        ids, begins = shard.first(windows)
        for bucket, a, b in slices(keys, buckets):
            rows.append({
                "shard": number, "bucket": bucket, "hot": True, "keys": keys[a:b].tobytes(), "seeds": more[a:b].tobytes(),
                "ids": ids[a:b].tobytes(), "begins": begins[a:b].tobytes(), "bytes": np.unique(seeds[a:b]).tobytes(),
            })
        return pa.Table.from_pylist(rows, _ASKED)

    return ask


def _window_keys(shard: Shard, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the window at each place."""
    keys = np.empty((2, len(at)), np.uint64)
    for a in range(0, len(at), _BLOCK // MATCH):
        rows = np.lib.stride_tricks.sliding_window_view(shard.data, MATCH)[at[a : a + _BLOCK // MATCH]]
        for table in range(2):
            keys[table, a : a + len(rows)] = _mixed((_RANDOM[table][rows] * _UP[:MATCH]).sum(axis=1, dtype=np.uint64))
    return keys[0], keys[1]


def _hot_windows(shard: Shard, found: Contexts, heads: np.ndarray) -> tuple[np.ndarray, ...]:
    """First place, two hashes and seed of every distinct window of some contexts, in the order of the first hash."""
    at = _all_windows(found, heads)
    seeds = np.repeat(found.seed[heads], found.high[heads] - found.low[heads] + 1)
    ids, begins = shard.first(at)
    keys, more = _window_keys(shard, at)
    order = np.lexsort((begins, ids, keys))
    new = order[np.diff(keys[order], prepend=keys[order][:1] + np.uint64(1)) != 0]
    return at[new], keys[new], more[new], seeds[new]


def _all_windows(found: Contexts, which: np.ndarray) -> np.ndarray:
    counts = found.high[which] - found.low[which] + 1
    return np.repeat(found.low[which] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _dense_rank(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ranks by document and start; equal ones share a rank."""
    order = np.lexsort((begins, ids))
    new = (np.diff(ids[order], prepend=ids[order][:1]) != 0) | (np.diff(begins[order], prepend=begins[order][:1]) != 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _settle(array_bytes: int):
    """For each window of the contexts of a bucket: is there an equal one that starts earlier?"""

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.concatenate(column_arrays(table, "ids", np.int64))
        begins = np.concatenate(column_arrays(table, "begins", np.int64))
        per_row = [len(keys) for keys in column_arrays(table, "keys", np.uint64)]
        cuts = np.cumsum(per_row)[:-1]
        if key[1].as_py():
            first, second = (np.concatenate(column_arrays(table, name, np.uint64)) for name in ("keys", "seeds"))
            later = _later_of_equal(_numbered(first, second), _dense_rank(ids, begins))
            bits = np.split(later, cuts)
        else:
            sizes = np.concatenate(column_arrays(table, "sizes", np.uint16)).astype(np.int64)
            seeds = np.concatenate(column_arrays(table, "seeds", np.uint64))
            data = np.concatenate(column_arrays(table, "bytes", np.uint8))
            later = _later_windows(data, sizes, seeds, ids, begins, array_bytes)
            ends = np.cumsum(sizes - MATCH + 1)
            bits = np.split(later, ends[cuts - 1]) if len(cuts) else [later]
        seeds_of_hot = table["bytes"] if key[1].as_py() else pa.nulls(len(table), pa.binary())
        packed = pa.array([np.packbits(part).tobytes() for part in bits], pa.binary())
        return pa.table([table["shard"], table["hot"], table["keys"], seeds_of_hot, packed], schema=_TOLD)

    return settle


def _numbered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs."""
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number


def _later_of_equal(kind: np.ndarray, rank: np.ndarray) -> np.ndarray:
    least = np.full(kind.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, rank)
    return rank > least[kind]


def _later_windows(data, sizes, seeds, ids, begins, array_bytes: int) -> np.ndarray:
    """For the windows of all contexts, end to end."""
    starts = np.cumsum(sizes) - sizes
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    kind = np.array([known.setdefault(raw[a : a + n], len(known)) for a, n in zip(starts.tolist(), sizes.tolist())])
    counts = sizes - MATCH + 1
    later = np.repeat(_later_of_equal(kind, _dense_rank(ids, begins)), counts)
    # the first context of each kind stands for it; kinds that are alone with their seed are settled
    order = np.lexsort((begins, ids, kind))
    heads = order[np.diff(kind[order], prepend=-1) != 0]
    seed_kinds, entry = np.unique(seeds[heads], return_inverse=True)
    contested = heads[np.bincount(entry, minlength=len(seed_kinds))[entry] > 1]
    if not len(contested):
        return later
    contested = contested[np.argsort(seeds[contested], kind="stable")]
    n = counts[contested]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rank = _dense_rank(np.repeat(ids[contested], n), np.repeat(begins[contested], n) + inner)
    equal = _equal_windows(data, starts[contested], sizes[contested], seeds[contested], array_bytes)
    slot = np.repeat((np.cumsum(counts) - counts)[contested], n) + inner
    later[slot] |= _later_of_equal(equal, rank)
    return later


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size, end to end."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _equal_windows(data, starts, sizes, seeds, array_bytes: int) -> np.ndarray:
    """A number for each window of contexts in the order of their seeds, equal for equal windows.

    Contexts of one seed are in one suffix array, if they fit; windows of different seeds are different anyway.
    """
    ends = np.cumsum(sizes + 1)
    own = ends - sizes - 1
    first = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]]))
    last = np.concatenate([first[1:], [len(seeds)]]) - 1
    fits = ends[last] - own[first] <= array_bytes
    array = np.where(np.repeat(fits, last - first + 1), np.repeat(own[first], last - first + 1), own) // array_bytes
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(array)) + 1, [len(seeds)]])
    counts = sizes - MATCH + 1
    before = np.concatenate([[0], np.cumsum(counts)])
    groups, heads = np.empty(before[-1], np.int64), []  # a window of each group, in sorted order for each array
    for a, b in zip(cuts, cuts[1:]):
        at = own[a:b] - own[a]
        joined = np.zeros(int(ends[b - 1] - own[a]), np.int64)  # 0 ends a context
        joined[_stretches(at, sizes[a:b])] = data[_stretches(starts[a:b], sizes[a:b])].astype(np.int64) + 1
        order = sa.suffix_array(joined)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(sa.common_prefixes(joined, order, MATCH) < MATCH)
        _, head, number = np.unique(group[_stretches(at, counts[a:b])], return_index=True, return_inverse=True)
        groups[before[a] : before[b]] = number + sum(map(len, heads))
        heads.append(before[a] + head)
    for seed in np.flatnonzero(~fits):
        _merge_seed(groups, heads, slice(before[first[seed]], before[last[seed] + 1]), data, starts, counts)
    return groups


def _merge_seed(groups, heads, windows: slice, data, starts, counts) -> None:
    """Gives equal windows of one seed, which is in several arrays, one number."""
    place = _stretches(starts, counts)
    mine = [head[(head >= windows.start) & (head < windows.stop)] for head in heads]
    mine = [head for head in mine if len(head)]
    number = _merged([sa.windows(data, place[head], MATCH) for head in mine])
    old = groups[np.concatenate(mine)]
    new = old[np.unique(number, return_index=True)[1]][number]
    order = np.argsort(old)
    groups[windows] = new[order][np.searchsorted(old[order], groups[windows])]


def _merged(arrays: list[np.ndarray]) -> np.ndarray:
    """New numbers for the sorted distinct windows of several arrays: equal ones, found by binary search, get one."""
    numbers = [np.arange(len(arrays[0]))]
    whole, number = arrays[0], numbers[0]
    for windows in arrays[1:]:
        found = sa.search(whole, windows)
        own = np.where(found >= 0, number[found], 0)
        fresh = found < 0
        own[fresh] = len(whole) + np.arange(fresh.sum())
        numbers.append(own)
        whole, number = np.concatenate([whole, windows[fresh]]), np.concatenate([number, own[fresh]])
        order = np.lexsort(whole.T[::-1])
        whole, number = whole[order], number[order]
    return np.concatenate(numbers)


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()),
])
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def covered(shard: Shard, told: pa.Table) -> np.ndarray:
    """True for the bytes to remove."""
    found = shard.contexts()
    cover = np.zeros(len(shard.data) + 1, np.int32)
    if not len(found.low):
        return cover[:-1] > 0
    heads, of, is_first = shard.classes(found)
    copies, firsts = np.flatnonzero(~is_first), np.flatnonzero(is_first)
    np.add.at(cover, found.low[copies], 1)
    np.add.at(cover, found.high[copies] + MATCH, -1)
    hot_keys, hot_flags = [np.empty(0, np.uint64)], [np.empty(0, bool)]
    hot_seeds = [np.empty(0, np.uint64)]
    hashes, later = found.hash[heads], []
    columns = (column_arrays(told, "keys", np.uint64), column_arrays(told, "bits", np.uint8))
    for row, (keys, bits) in enumerate(zip(*columns)):
        flags = np.unpackbits(bits).astype(bool)
        if told["hot"][row].as_py():
            hot_keys.append(keys)
            hot_flags.append(flags[: len(keys)])
            hot_seeds.append(np.frombuffer(told["seeds"][row].as_py(), np.uint64))
            continue
        kinds = np.searchsorted(hashes, keys)
        counts = found.high[heads[kinds]] - found.low[heads[kinds]] + 1
        begin = np.full(len(heads), -1, np.int64)
        begin[kinds] = np.cumsum(counts) - counts
        mine = firsts[begin[of[firsts]] >= 0]
        sizes = found.high[mine] - found.low[mine] + 1
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        later.append(_all_windows(found, mine)[flags[np.repeat(begin[of[mine]], sizes) + inner]])
    crowded = firsts[np.isin(found.seed[firsts], np.concatenate(hot_seeds))]
    if len(crowded):
        at = _all_windows(found, crowded)
        keys, order = np.concatenate(hot_keys), np.argsort(np.concatenate(hot_keys))
        entry = order[np.searchsorted(keys[order], _window_keys(shard, at)[0])]
        here = _later_of_equal(entry, _dense_rank(*shard.first(at)))
        later.append(at[here | np.concatenate(hot_flags)[entry]])
    windows = np.concatenate([np.empty(0, np.int64), *later])
    np.add.at(cover, windows, 1)
    np.add.at(cover, windows + MATCH, -1)
    return np.cumsum(cover[:-1]) > 0


def _remove(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
    shard = Shard(texts)
    cover = covered(shard, told)
    begins = cover & ~np.concatenate([[False], cover[:-1]])
    begins[shard.starts[shard.starts < shard.ends]] = cover[shard.starts[shard.starts < shard.ends]]
    removed, spans = (np.concatenate([[0], np.cumsum(flags)]) for flags in (cover, begins))
    kept = [
        hashlib.sha256(shard.data[a:b][~cover[a:b]]).hexdigest() for a, b in zip(shard.starts.tolist(), shard.ends.tolist())
    ]
    return pa.table([
        texts["doc_id"], shard.ends - shard.starts, removed[shard.ends] - removed[shard.starts],
        spans[shard.ends] - spans[shard.starts], kept,
    ], schema=_RESULT)


def remove_repeats(documents: DataFrame, hot: int = HOT, array_bytes: int = ARRAY_BYTES, shard_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of (doc_id, text)."""
    shards = shard_count(documents, shard_bytes) if shard_bytes else shard_count(documents)
    rows = sharded(documents, shards)
    counts = rows.groupBy("shard").applyInArrow(_count_seeds(shards), COUNTS_DDL)
    totals = sum_counts(counts).groupBy("shard")
    asked = rows.groupBy("shard").cogroup(totals).applyInArrow(_ask(shards, hot), _ASKED_DDL)
    told = asked.groupBy("bucket", "hot").applyInArrow(_settle(array_bytes), _TOLD_DDL)
    return rows.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_remove, RESULT)
