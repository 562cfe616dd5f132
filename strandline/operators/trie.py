"""Vocabularies as double-array tries: a few numpy arrays, walked for all words of a batch at once.

A state is a place in the arrays. From state ``s`` the byte ``b`` leads to ``base[s] + b``, if ``check`` has ``s``
there. ``ids`` has the piece that ends in a state, or -1. A piece takes some 20 bytes, and nothing is built per piece
where the trie is used: arrays are read as they come.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandline.constants import CONTINUATION, UNK

ROOT = 256  # lower places stay empty, so that base is never negative and state 0 leads nowhere
_NOWHERE, _BYTES = 0, 256
#: Places that are tried at once for the children of a state.
_TRIED = 256


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array without nulls, and where each text starts; the last entry is the end."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), starts


@dataclass(frozen=True)
class Trie:
    base: np.ndarray
    check: np.ndarray
    ids: np.ndarray
    continuation: int  # where pieces inside a word begin

    @classmethod
    def of(cls, vocabulary: pa.Table) -> "Trie":
        """From columns ``piece`` and ``id``. Of a piece that comes twice one id counts, the larger."""
        table = vocabulary.select(["piece", "id"]).filter(pc.is_valid(vocabulary["piece"]))
        table = table.group_by("piece").aggregate([("id", "max")])
        data, starts = flat_bytes(table["piece"].combine_chunks())
        order = np.array(sorted(range(len(table)), key=list(map(str.encode, table["piece"].to_pylist())).__getitem__), np.int64)
        builder = _Builder(data, starts[:-1][order], np.diff(starts)[order], table["id_max"].to_numpy()[order])
        builder.build()
        trie = cls(builder.base, builder.check, builder.ids, _NOWHERE)
        return cls(trie.base, trie.check, trie.ids, trie.state_of(CONTINUATION))

    @property
    def size(self) -> int:
        """Bytes of all arrays."""
        return self.base.nbytes + self.check.nbytes + self.ids.nbytes

    def state_of(self, beginning: str) -> int:
        state = ROOT
        for byte in beginning.encode():
            place = self.base[state] + byte
            if self.check[place] != state:
                return _NOWHERE
            state = int(place)
        return state

    def split(self, words: pa.Array, subword: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where those of each word start): the longest pieces from the left, or [UNK] if a rest has none.

        Without ``subword`` only whole words are looked for. All words take a step at once.
        """
        data, bounds = flat_bytes(words)
        n, ends = len(words), bounds[1:]
        at, state = bounds[:-1].copy(), np.full(n, ROOT, np.int64)
        piece, piece_end = np.full(n, -1, np.int64), bounds[:-1].copy()
        unknown, active = np.zeros(n, bool), np.arange(n)
        found_words, found_ids = [], []
        while len(active):
            more = at[active] < ends[active]
            going = active[more]
            place = self.base[state[going]].astype(np.int64) + data[at[going]]
            right = self.check[place] == state[going]
            going, place = going[right], place[right]
            state[going] = place
            at[going] += 1
            ended = self.ids[place] >= 0
            piece[going[ended]], piece_end[going[ended]] = self.ids[place[ended]], at[going[ended]]
            more[more] = right
            stopped = active[~more]
            good = (piece[stopped] >= 0) & (subword | (piece_end[stopped] == ends[stopped]))
            unknown[stopped[~good]] = True
            done = stopped[good]
            found_words.append(done)
            found_ids.append(piece[done])
            rest = done[piece_end[done] < ends[done]]
            at[rest], state[rest], piece[rest] = piece_end[rest], self.continuation, -1
            more[~more] = np.isin(stopped, rest, assume_unique=True)
            active = active[more]
        word = np.concatenate([*found_words, np.flatnonzero(unknown)])
        ids = np.concatenate([*found_ids, np.full(int(unknown.sum()), -1)]).astype(np.int64)
        keep = (ids < 0) | ~unknown[word]
        word, ids = word[keep], np.where(ids < 0, UNK, ids)[keep]
        order = np.argsort(word, kind="stable")  # pieces of a word came in their order
        return ids[order].astype(np.int32), np.searchsorted(word[order], np.arange(n + 1))

    def encode(self, texts: pa.Array, subword: bool) -> tuple[pa.ListArray, pa.Array]:
        """The ids of the words between single spaces, and for each id whether a word starts there.

        Each distinct word of the batch is split once. Null and empty texts have no words.
        """
        texts = texts.fill_null("")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        ids, bounds = self.split(coded.dictionary, subword)
        index = coded.indices.to_numpy().astype(np.int64)
        sizes = np.diff(bounds)[index]
        own = np.repeat(pc.binary_length(texts).to_numpy() > 0, np.diff(lists.offsets.to_numpy()))
        sizes = np.where(own, sizes, 0)
        before = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        flat = ids[np.repeat(bounds[index] - before, sizes) + np.arange(total)]
        starts = np.zeros(total, bool)
        starts[before[sizes > 0]] = True
        ends = np.concatenate([[0], np.cumsum(sizes)])
        offsets = pa.array(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(starts))


class _Builder:
    """Places the states of sorted distinct pieces, one byte of depth after the other."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray):
        self.data, self.starts, self.sizes, self.numbers = data, starts, sizes, numbers
        room = ROOT + 2 * _BYTES + int(1.2 * sizes.sum())
        self.base, self.ids = np.zeros(room, np.int32), np.full(room, -1, np.int32)
        self.check = np.full(room, -1, np.int32)
        self.check[ROOT], self.low, self.top = ROOT, ROOT + 1, ROOT

    def build(self) -> None:
        low, high = np.array([0]), np.array([len(self.sizes)])
        state, depth = np.array([ROOT]), 0
        while len(state):
            ended = (low < high) & (self.sizes[np.minimum(low, len(self.sizes) - 1)] == depth) if len(self.sizes) else low > 0
            self.ids[state[ended]] = self.numbers[low[ended]]
            low = low + ended
            state, low, high = self._children(state, low, high, depth)
            depth += 1
        end = self.top + _BYTES + 1
        self.base, self.check, self.ids = self.base[:end].copy(), self.check[:end].copy(), self.ids[:end].copy()

    def _children(self, state, low, high, depth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states one byte further, and which pieces begin so."""
        counts = high - low
        owner = np.repeat(np.arange(len(state)), counts)
        piece = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        byte = self.data[self.starts[piece] + depth].astype(np.int64)
        new = np.ones(len(piece), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (byte[1:] != byte[:-1])
        first = np.flatnonzero(new)
        owner, byte, begin = owner[first], byte[first], piece[first]
        end = np.append(piece[first[1:] - 1], piece[-1:]) + 1 if len(first) else begin
        place = np.zeros(len(first), np.int64)
        width = np.bincount(owner, minlength=len(state))
        cut = np.concatenate([[0], np.cumsum(width)])
        for parent in np.flatnonzero(width > 1)[np.argsort(-width[width > 1], kind="stable")].tolist():
            group = slice(int(cut[parent]), int(cut[parent + 1]))
            base = self._fit(byte[group])
            self.base[state[parent]], place[group] = base, base + byte[group]
            self._take(place[group], int(state[parent]))
        alone = np.flatnonzero(width == 1)
        if len(alone):
            child = cut[alone]
            place[child] = self._free(len(alone))
            self.base[state[alone]] = place[child] - byte[child]
            self._take(place[child], state[alone])
        return place, begin, end

    def _take(self, places: np.ndarray, states) -> None:
        self.check[places] = states
        self.top = max(self.top, int(places.max()))

    def _grow(self, room: int) -> None:
        if room > len(self.check):
            more = max(room, len(self.check) * 3 // 2) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.ids = np.concatenate([self.ids, np.full(more, -1, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def _free(self, n: int) -> np.ndarray:
        """The first n free places."""
        self._grow(self.top + n + 2 * _BYTES)
        free = np.flatnonzero(self.check[ROOT + 1 : self.top + n + 2] < 0)[:n] + ROOT + 1
        return free

    def _fit(self, byte: np.ndarray) -> int:
        """A base that puts all children on free places."""
        self._grow(self.top + 4 * _BYTES)
        free = np.flatnonzero(self.check[self.low : self.top + 1] < 0)[:_TRIED] + self.low
        tried = free - byte[0]
        tried = tried[tried > 0]
        good = np.flatnonzero((self.check[tried[:, None] + byte] < 0).all(axis=1))
        if len(good):
            return int(tried[good[0]])
        if len(free):
            self.low = int(free[-1]) + 1  # crowded up to here: left to states with one child
        return self.top + 1 - int(byte[0])
