"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

A token's score is the share of its n-gram among those with its history; if no other document has the n-gram, it is
``BACKOFF`` times the score with a shorter history, at last the share of the word among all tokens. Counts are of the
whole corpus, less those of the document itself, which would else vouch for all its n-grams.

Shards count the n-grams of their documents. The count tables are partitioned by the hash of the n-gram and joined to
the shards' n-grams: a bucket adds up what all shards have and answers with what the others have,
which is nothing for an n-gram of one shard. Shards then sum up the scores of
each document. An n-gram that stands everywhere reaches its bucket once per shard, combined.

Words and bigrams are joined first. A longer n-gram can only stand in another shard if both n-grams of one token less
do, the one it begins and the one it ends with; so trigrams are sent when the answers for bigrams are there, and those
that no other shard can have, over half of them, are counted where they are and never move.

Tokens are runs without ASCII white space, in lower case; n-grams are told apart by 64-bit hashes. Null and empty
texts have no tokens and the score 0. Rows that repeat a ``doc_id`` are documents of their own, null ids too. Other
columns are not read. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, functions as F

from strandline.llm.sharding import COUNTS, COUNTS_DDL, column_arrays, shard_count, sharded, slices

BACKOFF = 0.4
#: Trigrams, with bigrams and words to back off to.
ORDER = 3

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], np.uint64)
_ANSWERS = "shard int, n int, bucket int, others binary"
RESULT = "doc_id bigint, n_tokens bigint, log_score double, mean_log_score double"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


class Grams:
    """The n-grams of some texts: ``keys[n - 1][i]`` is that of the n tokens up to token i, 0 where a text has fewer."""

    def __init__(self, texts: list[str | None], order: int):
        lowered = pa.array([(text or "").lower() for text in texts], pa.large_string())
        lists = pc.ascii_split_whitespace(lowered)  # as ``tokens`` does, but for empty ones at the ends
        flat = lists.flatten()
        real = pc.binary_length(flat).to_numpy() > 0
        document = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[real]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False)
        hashes = hash_array(known, categorize=False) if len(known) else np.empty(0, np.uint64)
        words = hashes[coded.indices.to_numpy()]
        self.document, self.sizes = document, np.bincount(document, minlength=len(texts))
        self.place = np.arange(len(words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.keys = [words]
        for n in range(2, order + 1):
            longer = np.zeros(len(words), np.uint64)
            longer[1:] = _mixed(self.keys[-1][:-1] * _MULTIPLIERS[0] + words[1:])
            longer[self.place < n - 1] = 0
            self.keys.append(longer)
        self._counted: dict[int, Counted] = {}

    def counted(self, n: int) -> "Counted":
        """The n-grams of ``n`` + 1 tokens, sorted once."""
        if n not in self._counted:
            self._counted[n] = Counted(self.keys[n], self.place >= n, self.document)
        return self._counted[n]

    def distinct(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted keys and counts by order. Histories are n-grams that don't end their text, so they are here too."""
        return [np.unique(keys[self.place >= n], return_counts=True) for n, keys in enumerate(self.keys)]


class Counted:
    """The distinct n-grams of one order: ``keys`` and ``counts``; by token the ``entry`` among them (0 where a text has
    fewer tokens), and how often the token's own document has it (``own``)."""

    def __init__(self, keys: np.ndarray, has: np.ndarray, document: np.ndarray):
        places = np.flatnonzero(has)
        order = places[np.argsort(keys[places], kind="stable")]  # equal keys stay in the order of documents
        keys, document = keys[order], document[order]
        new = np.ones(len(order), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        self.keys, self.counts = keys[first], np.diff(np.append(first, len(order)))
        self.entry, self.own = np.zeros(len(has), np.int64), np.zeros(len(has), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        new[1:] |= document[1:] != document[:-1]
        first = np.flatnonzero(new)
        runs = np.diff(np.append(first, len(order)))
        self.own[order] = np.repeat(runs, runs)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLIERS[1]
    return x ^ (x >> np.uint64(32))


def _counts_of(shard, n: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[dict]:
    return [
        {"shard": shard, "n": n, "bucket": bucket, "keys": packed_keys(keys[start:end]), "counts": packed_extra(counts[start:end] - 1)}
        for bucket, start, end in slices(keys, buckets)
    ]


def _count_shard(buckets: int, order: int):
    """The words and bigrams of a shard."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        distinct = Grams(table["text"].to_pylist(), min(order, 2)).distinct()
        rows = [row for n, found in enumerate(distinct) for row in _counts_of(key[0].as_py(), n, *found, buckets)]
        return pa.Table.from_pylist(rows, COUNTS)

    return count


def _count_longer(buckets: int, n: int):
    """Of the n-grams of ``n`` + 1 tokens those that another shard may have."""

    def count(key: tuple, documents: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(documents["text"].to_pylist(), n + 1)
        before = np.empty(0)
        for m in range(1, n):
            has = _perhaps_elsewhere(grams, m, before)
            keys = np.unique(grams.keys[m][has])
            before = has & _among(keys[_answers_to(keys, m, answers, buckets) > 0], grams.keys[m])
        found = np.unique(grams.keys[n][_perhaps_elsewhere(grams, n, before)], return_counts=True)
        return pa.Table.from_pylist(_counts_of(key[0].as_py(), n, *found, buckets), COUNTS)

    return count


def _among(few: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(few):
        return np.zeros(len(keys), bool)
    return few[np.minimum(np.searchsorted(few, keys), len(few) - 1)] == keys


def _perhaps_elsewhere(grams: Grams, n: int, before: np.ndarray) -> np.ndarray:
    """Whether the n-gram of ``n`` + 1 tokens up to each token is sent: ``before`` says which of one token less others have."""
    has = grams.place >= n
    if n > 1:
        has = has & before
        has[1:] &= before[:-1]
    return has


def _answers_to(keys: np.ndarray, n: int, answers: pa.Table, buckets: int) -> np.ndarray:
    """How often other shards have the n-grams of ``n`` + 1 tokens that were sent."""
    of_order = answers.filter(pc.equal(answers["n"], n))
    parts = dict(zip(of_order["bucket"].to_pylist(), column_arrays(of_order, "others", np.uint8)))
    found = [unpacked_extra(parts[bucket], end - start) for bucket, start, end in slices(keys, buckets)]
    return np.concatenate([np.empty(0, np.int64), *found])


def _in_other_shards(grams: Grams, answers: pa.Table, buckets: int, n: int, before: np.ndarray) -> np.ndarray:
    """The same for each distinct n-gram, sent or not."""
    counted = grams.counted(n)
    sent = np.zeros(len(counted.keys), bool)
    sent[counted.entry[_perhaps_elsewhere(grams, n, before)]] = True
    others = np.zeros(len(counted.keys), np.int64)
    others[sent] = _answers_to(counted.keys[sent], n, answers, buckets)
    return others


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps, in as many bytes as the largest gap takes: the first key, that width, the bytes in planes."""
    gaps = np.diff(keys)
    width = (int(gaps.max(initial=0)).bit_length() + 7) // 8
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return keys[:1].astype("<u8").tobytes() + bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpacked_keys(data: np.ndarray) -> np.ndarray:
    width = int(data[8])
    planes = data[9:].reshape(width, -1).T if width else np.empty((0, 0), np.uint8)
    gaps = np.zeros((len(planes), 8), np.uint8)
    gaps[:, :width] = planes
    return np.cumsum(np.concatenate([data[:8].copy().view("<u8"), gaps.reshape(-1).view("<u8")]), dtype=np.uint64)


_LARGE = 255


def packed_extra(extra: np.ndarray) -> bytes:
    """Numbers of which most are zero and few are large: a bit for each, a byte for others, int64 where that is full."""
    some = extra[extra > 0]
    return np.packbits(extra > 0).tobytes() + np.minimum(some, _LARGE).astype(np.uint8).tobytes() + some[some >= _LARGE].astype(np.int64).tobytes()


def unpacked_extra(data: np.ndarray, size: int) -> np.ndarray:
    bits = (size + 7) // 8
    places = np.flatnonzero(np.unpackbits(data[:bits], count=size))
    some = data[bits : bits + len(places)].astype(np.int64)
    some[some == _LARGE] = data[bits + len(places) :].copy().view(np.int64)
    extra = np.zeros(size, np.int64)
    extra[places] = some
    return extra


def _answer(table: pa.Table) -> pa.Table:
    """For every key of every slice its count in the other shards, which is nothing where only one shard has it."""
    keys = [unpacked_keys(data) for data in column_arrays(table, "keys", np.uint8)]
    counts = [1 + unpacked_extra(data, len(k)) for data, k in zip(column_arrays(table, "counts", np.uint8), keys)]
    distinct, entry = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.concatenate(counts)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, entry, own)
    others = np.split(totals[entry] - own, np.cumsum([len(k) for k in keys])[:-1])
    answers = pa.array([packed_extra(part) for part in others], pa.binary())
    return pa.table([table["shard"], table["n"], table["bucket"], answers], names=["shard", "n", "bucket", "others"])


def scores(grams: Grams, totals: list[np.ndarray], all_tokens: int) -> np.ndarray:
    """The summed log scores of the texts, given the corpus counts of the sorted distinct n-grams by order."""
    others = []  # by order: how often other documents have the n-gram up to each token
    for n, total in enumerate(totals):
        counted = grams.counted(n)
        has = grams.place >= n
        others.append(np.where(has, total[counted.entry] - counted.own, 0) if len(total) else np.zeros(len(has), np.int64))
    outside = all_tokens - grams.sizes[grams.document]
    share = np.where(others[0] > 0, others[0], 1) / (outside + (others[0] == 0))
    for n in range(1, len(others)):
        before = np.concatenate([[0], others[n - 1][:-1]])
        known = others[n] > 0
        share = np.where(known, others[n] / np.maximum(before, 1), np.where(grams.place >= n, BACKOFF * share, share))
    return np.bincount(grams.document, np.log(share), len(grams.sizes))


def _score_shard(buckets: int, order: int, all_tokens: int):
    def score(documents: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(documents["text"].to_pylist(), order)
        totals, before = [], np.empty(0)
        for n in range(order):
            others = _in_other_shards(grams, answers, buckets, n, before)
            before = others[grams.counted(n).entry] > 0 if len(others) else np.zeros(len(grams.place), bool)
            totals.append(grams.counted(n).counts + others)
        sums = scores(grams, totals, all_tokens)
        means = sums / np.maximum(grams.sizes, 1)
        return pa.table({
            "doc_id": documents["doc_id"], "n_tokens": grams.sizes, "log_score": sums, "mean_log_score": means
        })

    return score


def lm_scores(documents: DataFrame, order: int = ORDER, shard_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score): natural logarithms, summed and per token."""
    shards = shard_count(documents, shard_bytes) if shard_bytes else shard_count(documents)
    counted = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    all_tokens = documents.agg(counted).first()[0] or 0
    rows = sharded(documents, shards)
    counts = rows.groupBy("shard").applyInArrow(_count_shard(shards, order), COUNTS_DDL)
    others = counts.groupBy("n", "bucket").applyInArrow(_answer, _ANSWERS)
    for n in range(2, order):
        more = rows.groupBy("shard").cogroup(others.groupBy("shard")).applyInArrow(_count_longer(shards, n), COUNTS_DDL)
        others = others.unionByName(more.groupBy("n", "bucket").applyInArrow(_answer, _ANSWERS))
    both = rows.groupBy("shard").cogroup(others.groupBy("shard"))
    return both.applyInArrow(_score_shard(shards, order, all_tokens), RESULT)
