"""Benchmark decontamination: rare n-grams join documents to items, Smith-Waterman alignment scores them.

An item is aligned with the words of a document: a match counts 2; replaced, added and left out words -1; the score is
a share of the item's full score. What a copy that passes may lose, 0.7 of the item's words (``Limits.cost``), bounds how
many of the item's word pairs it breaks: a replaced or left out word costs 3 and breaks two, an added one costs 1 and
breaks one. So one more than that many of the pairs, whichever they are, hold one that is unbroken. The rarest ones are
the item's seeds; how often pairs stand in the corpus is counted over all documents. Items of three words have single
words in place of pairs, as none of their pairs needs to be left.

Documents and items that share a seed are looked at in a second step with all pairs of the item: a copy has at least
``Limits.left`` of them, at places that differ by no more than it may add and leave out. Around these, the item is aligned
with all words that a copy may reach to. The result is that of aligning every item with every document in full.

The benchmark is read in blocks of bounded size, and every block is held against all documents without a shuffle of
texts: one pass counts, one finds.

Words are runs of characters other than white space and punctuation, in lower case. Null texts have none. Items of one
or two words can't be told from chance inside a text: they count where they are all a document has. Items without words
are left out. Rows that repeat an id count each for themselves, null ids too; equal results are returned once. Other
columns are not read. If either table is empty, so is the result.
"""

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.operators.ordering import broadcast_if_small
from strandline.sources.shared import stored

#: Items of fewer words have no seeds.
LEAST_WORDS = 3
MATCH, CHANGE = 2, -1
#: One word in five replaced leaves 0.7 of the full score; short items lose a little more by one word.
THRESHOLD = 0.65
BLOCK_BYTES = 4 << 20
#: Words that are counted at once; arrays over them take some ten times eight bytes. A longer text comes alone.
COUNTED_WORDS = 1 << 18
#: Texts to drop that every executor is told; more of them meet the documents in a shuffle.
TOLD_TEXTS = 200_000

#: ASCII letters in lower case, digits as they are, other ASCII characters as spaces; then punctuation beyond ASCII:
#: Latin-1 signs, general, CJK and full-width punctuation.
_ASCII = bytes(ord(c) if (c := chr(i).lower()).isalnum() or i > 127 else 32 for i in range(128)) + bytes(range(128, 256))
_SIGNS = re.compile(rb"\xc2[\xa0-\xbf]|\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\xbf]|\xef\xbc[\x81-\x8f]")
RESULT = "doc_id bigint, item_id bigint, score double, window_start int, window_end int"
_FOUND = RESULT + ", text_sha256 string"


def words(text: str | None) -> list[bytes]:
    """In UTF-8. Splitting bytes takes a third of the time of finding words in a text."""
    data = (text or "").lower().encode().translate(_ASCII)
    return (data if data.isascii() else _SIGNS.sub(b" ", data)).split()


@dataclass(frozen=True)
class Limits:
    """What a copy of ``size`` words that reaches ``THRESHOLD`` can lose."""

    size: int

    @property
    def width(self) -> int:
        """Words of an n-gram."""
        return 2 if self.size > LEAST_WORDS else 1

    @property
    def cost(self) -> int:
        """What the score may fall short by, and the most words that may be added."""
        return int(MATCH * self.size * (1 - THRESHOLD) + 1e-9)

    @property
    def broken(self) -> int:
        """N-grams at most that aren't in the copy: a pair costs 1 or more, a single word 2 or more."""
        return self.cost if self.width == 2 else self.cost // MATCH

    @property
    def left(self) -> int:
        return self.size - self.width + 1 - self.broken


@dataclass
class Grams:
    """All n-grams of one width: sorted codes with the item and the place of each; which entries are seeds."""

    width: int
    codes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seeds: np.ndarray
    by_item: np.ndarray  # entries in the order of their items, and where each item's begin
    starts: np.ndarray

    @classmethod
    def of(cls, width: int, texts: list[np.ndarray], size: int) -> "Grams":
        has = [len(text) >= LEAST_WORDS and Limits(len(text)).width == width for text in texts]
        own = [grams(text if one else text[:0], width, size) for text, one in zip(texts, has)]
        sizes = [len(codes) for codes in own]
        codes = np.concatenate([np.empty(0, np.int64), *own])
        order = np.argsort(codes, kind="stable")
        place = np.concatenate([np.empty(0, np.int64), *map(np.arange, sizes)])
        item = np.repeat(np.arange(len(texts)), sizes)[order]
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return cls(width, codes[order], item, place[order], np.arange(len(codes)), np.argsort(item, kind="stable"), starts)

    def with_rare_seeds(self, limits: list[Limits], counts: np.ndarray) -> "Grams":
        """``counts``: how often the corpus has each of ``codes``."""
        order = np.lexsort((self.place, counts, self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        broken = np.fromiter((limit.broken for limit in limits), np.int64, len(limits))
        return replace(self, seeds=np.sort(order[rank <= broken[item]]))

    def of_items(self, chosen: np.ndarray) -> np.ndarray:
        """The entries of some items."""
        return np.sort(np.concatenate([self.by_item[self.starts[i] : self.starts[i + 1]] for i in chosen]))

    def hits(self, codes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, place in the text) of every meeting of some entries and the text."""
        at = np.flatnonzero(codes >= 0)
        among = self.codes[entries]
        first, last = np.searchsorted(among, codes[at]), np.searchsorted(among, codes[at], "right")
        times = last - first
        entry = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        return entries[entry], np.repeat(at, times)


@dataclass
class Items:
    """A block of the benchmark: words as numbers, and n-grams of its items."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    words: list[np.ndarray]
    limits: list[Limits]
    grams: list[Grams]
    short: dict[tuple[int, ...], list[int]]  # items that have no n-grams, by their words

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> "Items":
        vocabulary: dict[bytes, int] = {}
        ids, texts, short = [], [], defaultdict(list)
        for item_id, text in rows:
            if found := words(text):
                ids.append(item_id)
                texts.append(np.array([vocabulary.setdefault(word, len(vocabulary)) for word in found], np.int64))
                if len(found) < LEAST_WORDS:
                    short[tuple(texts[-1].tolist())].append(len(ids) - 1)
        sets = [Grams.of(width, texts, len(vocabulary)) for width in (1, 2)]
        return cls(ids, vocabulary, texts, [Limits(len(text)) for text in texts], sets, dict(short))

    @cached_property
    def left(self) -> np.ndarray:
        return np.fromiter((limit.left for limit in self.limits), np.int64, len(self.limits))

    @cached_property
    def cost(self) -> np.ndarray:
        return np.fromiter((limit.cost for limit in self.limits), np.int64, len(self.limits))

    def numbers(self, text: str | None) -> np.ndarray:
        """The text's words, -1 for those that no item has."""
        found, get = words(text), self.vocabulary.get
        return np.fromiter((get(word, -1) for word in found), np.int64, len(found))

    def with_rare_seeds(self, counts: dict[tuple[int, int], int]) -> "Items":
        """``counts`` by width and code."""
        rare = [
            g.with_rare_seeds(self.limits, np.fromiter((counts.get((g.width, c), 0) for c in g.codes.tolist()), np.int64, len(g.codes)))
            for g in self.grams
        ]
        return replace(self, grams=rare)


def grams(numbers: np.ndarray, width: int, size: int) -> np.ndarray:
    """A number for each word or each two words in a row; negative if one of them is unknown."""
    if width == 1:
        return numbers
    a, b = numbers[:-1], numbers[1:]
    return np.where((a < 0) | (b < 0), -1, a * size + b)


def align(item: np.ndarray, window: np.ndarray) -> int:
    """The Smith-Waterman score of the best local alignment. A row of the matrix is computed at once."""
    steps = np.arange(1, len(window) + 1) * -CHANGE
    row, best = np.zeros(len(window) + 1, np.int64), 0
    for word in item:
        diagonal = row[:-1] + np.where(window == word, MATCH, CHANGE)
        start = np.maximum(np.maximum(diagonal, row[1:] + CHANGE), 0)
        row[1:] = np.maximum.accumulate(start + steps) - steps
        best = max(best, int(row.max()))
    return best


def find_in_text(items: Items, text: str | None) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, window start, window end) of the best window of every item that reaches ``THRESHOLD``."""
    numbers = items.numbers(text)
    for item in items.short.get(tuple(numbers.tolist()), ()) if 0 < len(numbers) < LEAST_WORDS else ():
        yield item, 1.0, 0, len(numbers)
    for kind in items.grams:
        codes = grams(numbers, kind.width, len(items.vocabulary))
        seeded = np.unique(kind.item[kind.hits(codes, kind.seeds)[0]])
        if not len(seeded):
            continue
        entry, at = kind.hits(codes, kind.of_items(seeded))
        for item, windows in _windows(items, kind.item[entry], at - kind.place[entry]):
            query, best = items.words[item], (0.0, 0, 0)
            for start, end in windows:
                start, end = max(0, start), min(len(numbers), end)
                if np.isin(query, numbers[start:end]).sum() / len(query) >= THRESHOLD:
                    best = max(best, (align(query, numbers[start:end]) / (MATCH * len(query)), -start, end))
            if best[0] >= THRESHOLD:
                yield item, best[0], -best[1], best[2]


def _windows(items: Items, item: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Stretches of the text where an item has n-grams enough, for every such item. ``begins``: where the item would begin."""
    order = np.lexsort((begins, item))
    item, begins = item[order], begins[order]
    last = np.arange(len(item)) + items.left[item] - 1
    inside = np.minimum(last, len(item) - 1)
    cost = items.cost[item]
    enough = (last == inside) & (item[inside] == item) & (begins[inside] - begins <= cost)
    item, begins, cost = item[enough], begins[enough], cost[enough]
    for one in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1) if len(item) else ():
        reach, size = int(cost[one[0]]), len(items.words[item[one[0]]])
        apart = np.flatnonzero(np.diff(begins[one]) > size + 2 * reach) + 1
        yield int(item[one[0]]), [(int(b[0]) - reach, int(b[-1]) + size + reach) for b in np.split(begins[one], apart)]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in lists of about ``block_bytes`` of text."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // block_bytes
    for block in range(n):
        yield [tuple(row) for row in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()]


def contaminations(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, window_start, window_end) of all documents that hold a copy of an item.

    The window is the stretch of words that was aligned.
    """
    texts = documents.select(F.col("doc_id").cast("long"), "text")
    return _found(texts, benchmark, block_bytes).drop("text_sha256").distinct()


def _found(texts: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The result with the digest of the text that was read."""
    parts = [_block(texts, with_corpus_counts(texts, Items.of(rows))) for rows in blocks(benchmark, block_bytes)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def with_corpus_counts(texts: DataFrame, items: Items) -> Items:
    """The items with their rarest n-grams as seeds. As many numbers reach the driver as the block has n-grams."""
    distinct = [(kind.width, np.unique(kind.codes)) for kind in items.grams if len(kind.codes)]
    if not distinct:
        return items

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(codes), np.int64) for _, codes in distinct]
        for numbers in _few_at_once(items, batches):
            for (width, codes), total in zip(distinct, totals):
                found = grams(numbers, width, len(items.vocabulary))
                at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                total += np.bincount(at[codes[at] == found], minlength=len(codes))
        for (width, codes), total in zip(distinct, totals):
            seen = np.flatnonzero(total)
            columns = [pa.array(np.full(len(seen), width)), pa.array(codes[seen]), pa.array(total[seen])]
            yield pa.RecordBatch.from_arrays(columns, ["width", "code", "n"])

    counted = texts.select("text").mapInArrow(count, "width bigint, code bigint, n bigint").groupBy("width", "code")
    return items.with_rare_seeds({(r.width, r.code): r.n for r in counted.agg(F.sum("n").alias("n")).toLocalIterator()})


def _few_at_once(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The words of some texts after each other, as numbers; -1 stands behind every text."""
    held, size, apart = [], 0, np.array([-1])
    for batch in batches:
        for text in batch["text"]:
            held += [items.numbers(text.as_py()), apart]
            size += len(held[-2]) + 1
            if size >= COUNTED_WORDS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _block(texts: DataFrame, items: Items) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, items.ids[item], score, start, end, hashlib.sha256(text.encode()).hexdigest())
                for doc_id, text in zip(batch["doc_id"].to_pylist(), (text.as_py() for text in batch["text"]))
                for item, score, start, end in find_in_text(items, text)
            ]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [column.split()[0] for column in _FOUND.split(", ")])

    return texts.mapInArrow(find, _FOUND)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a copy of an item, with all their columns. A row goes for its own text, whatever its id.

    Texts stay where they are, unless too many are dropped to be known everywhere.
    """
    found = _found(documents.select(F.col("doc_id").cast("long"), "text"), benchmark)
    dropped = stored(found.select(F.unhex("text_sha256").alias("__dropped")).distinct(), "dropped-texts")
    told = broadcast_if_small(dropped, TOLD_TEXTS)
    return documents.join(told, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)) == F.col("__dropped"), "left_anti")
