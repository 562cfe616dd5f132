"""Token counts of documents under a byte-level BPE vocabulary, by merging on a heap and a linked list.

A text is cut into words, as such vocabularies are trained, and a word into its bytes. The heap holds the adjacent
pairs that have a rank, the list what is adjacent; the pair of the lowest rank is merged, the leftmost first, until no
pair has a rank. The count is the number of bytes less the number of merges: no token is ever written down. A text
repeats its words, so a task counts each once and keeps the counts, ``KEPT_WORDS`` of them at most; longer and further
words are counted again. A word of n bytes takes n log n steps, however long it is. Nothing is shuffled.

The vocabulary is a file of the ``tokenizers`` library; its merges, a table as large as the file, go to the executors
once, so only the driver has to see the file. Strings of added tokens in a text are one token each, as the library has
it by default. Letters and numbers that Unicode got after version 15.1 are signs to the library, so they are here.

Null and empty texts have no tokens. Rows that repeat a ``doc_id`` are counted each for itself, null ids too. Other
columns are not read. An empty table gives an empty result.
"""

import json
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

LIMIT = 1024
KEPT_WORDS, KEPT_LETTERS = 500_000, 40

# How byte-level vocabularies cut a text into words.
LETTER, NUMBER = r"\p{L}", r"\p{N}"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"

_RESULT = "doc_id bigint, n_bytes bigint, n_tokens bigint"
_PLACE_BITS, _SYMBOL_BITS = 40, 24


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a vocabulary file: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(plain)]
    return {byte: chr(byte) for byte in plain} | {byte: chr(0x100 + i) for i, byte in enumerate(others)}


def later_letters(version: str = "15.1") -> str:
    """The ranges, as in a character class, of letters and numbers that are not assigned in Unicode 15.1."""
    if unicodedata.unidata_version[:4] != version:
        raise RuntimeError(f"the character tables of Python are of {unicodedata.unidata_version}, not {version}")
    known = regex.compile(rf"[{LETTER}{NUMBER}]")
    codes = [c for c in range(sys.maxunicode + 1) if known.match(chr(c)) and unicodedata.category(chr(c)) == "Cn"]
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of adjacent pairs and what they merge into; symbols are numbers, of single bytes by byte."""

    ranks: dict[int, int]
    merged: list[int]
    symbols: list[int]
    added: tuple[str, ...]
    later: str

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """A vocabulary file with byte-level words and plain merges; anything else is refused."""
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        model, cut = file["model"], file["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        odd += [k for token in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if token[k]]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or file["normalizer"] or odd:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary: {odd or cut}")
        vocabulary = model["vocab"]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        ranks: dict[int, int] = {}
        for rank, (left, right) in enumerate(pairs):
            ranks.setdefault(vocabulary[left] << _SYMBOL_BITS | vocabulary[right], rank)
        return cls(
            ranks,
            [vocabulary[left + right] for left, right in pairs],
            [vocabulary[letter] for _, letter in sorted(byte_letters().items())],
            tuple(token["content"] for token in file["added_tokens"]),
            later_letters(),
        )


def count_merges(word: bytes, vocabulary: Vocabulary) -> int:
    """How many pairs of a word merge."""
    ranks, merged = vocabulary.ranks, vocabulary.merged
    symbols = [vocabulary.symbols[byte] for byte in word]
    size = len(symbols)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = []
    for place in range(size - 1):
        rank = ranks.get(symbols[place] << _SYMBOL_BITS | symbols[place + 1])
        if rank is not None:
            heap.append(rank << _PLACE_BITS | place)
    heapify(heap)
    merges, places = 0, (1 << _PLACE_BITS) - 1
    while heap:
        top = heappop(heap)
        rank, place = top >> _PLACE_BITS, top & places
        right = after[place]
        # What was merged since has no place in the list or another symbol, and so another rank.
        if symbols[place] < 0 or right >= size or ranks.get(symbols[place] << _SYMBOL_BITS | symbols[right]) != rank:
            continue
        merges += 1
        symbols[place], symbols[right] = merged[rank], -1
        after[place] = following = after[right]
        if following < size:
            before[following] = place
            rank = ranks.get(symbols[place] << _SYMBOL_BITS | symbols[following])
            if rank is not None:
                heappush(heap, rank << _PLACE_BITS | place)
        previous = before[place]
        if previous >= 0:
            rank = ranks.get(symbols[previous] << _SYMBOL_BITS | symbols[place])
            if rank is not None:
                heappush(heap, rank << _PLACE_BITS | previous)
    return merges


class _Known(dict):
    """The tokens of words: counted when asked for, kept while there is room."""

    def __init__(self, vocabulary: Vocabulary, kept_words: int):
        super().__init__()
        self.vocabulary, self.kept_words = vocabulary, kept_words

    def __missing__(self, word: str) -> int:
        data = word.encode()
        found = len(data) - count_merges(data, self.vocabulary)
        if len(word) <= KEPT_LETTERS:
            if len(self) >= self.kept_words:
                self.clear()
            self[word] = found
        return found


class Counter:
    """Counts texts, one task's worth; remembers the counts of words."""

    def __init__(self, vocabulary: Vocabulary, kept_words: int = KEPT_WORDS):
        self.vocabulary = vocabulary
        self.tokens_of = _Known(vocabulary, kept_words).__getitem__

    @cached_property
    def _added(self) -> regex.Pattern:
        return regex.compile("|".join(map(regex.escape, sorted(self.vocabulary.added, key=len, reverse=True))))

    @cached_property
    def _words(self) -> regex.Pattern:
        return regex.compile(WORDS.replace("{letter}", LETTER).replace("{number}", NUMBER))

    @cached_property
    def _later(self) -> regex.Pattern:
        return regex.compile(f"[{self.vocabulary.later}]")

    @cached_property
    def _words_with_later(self) -> regex.Pattern:
        parts = {"letter": f"[{LETTER}--[{self.vocabulary.later}]]", "number": f"[{NUMBER}--[{self.vocabulary.later}]]"}
        return regex.compile("(?V1)" + WORDS.format(**parts))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(token in text for token in self.vocabulary.added):
            return self._plain(text)
        pieces = self._added.split(text)
        return len(pieces) - 1 + sum(map(self._plain, pieces))

    def _plain(self, text: str) -> int:
        """A text without added tokens."""
        cut = self._words
        if self.vocabulary.later and not text.isascii() and self._later.search(text):
            cut = self._words_with_later
        return sum(map(self.tokens_of, cut.findall(text)))


def token_counts(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of (doc_id, text); bytes are those of UTF-8."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            tokens = pa.array([counter.count(text) for text in batch["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], tokens], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return documents.select(F.col("doc_id").cast("long"), "text", size).mapInArrow(count, _RESULT)


def with_limit(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``over_limit``: more tokens than a training row has room for."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
