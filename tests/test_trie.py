"""The double-array trie against a dictionary, and word starts through chunks, padding and masking."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.constants import SPECIAL_PIECES
from strandline.operators.encoding import chunk_from_end, chunk_parts_from_end, decode, encode, pad_sequence
from strandline.operators.masking import mask_words
from strandline.operators.trie import Trie

LETTERS = "abcdeéü가나ß𐍈1"


def greedy(word, ids, subword):
    if not subword:
        return [ids.get(word, 0)]
    found, start = [], 0
    while start < len(word):
        mark = "##" if start else ""
        end = next((e for e in range(len(word), start, -1) if mark + word[start:e] in ids), None)
        if end is None:
            return [0]
        found.append(ids[mark + word[start:end]])
        start = end
    return found or [0]


def vocabulary(rng, n):
    pieces = {"".join(rng.choices(LETTERS, k=rng.randrange(1, 6))) for _ in range(n)}
    pieces |= {"##" + p for p in sorted(pieces)[::2]}
    return {p: i + 5 for i, p in enumerate(sorted(pieces, key=lambda _: rng.random()))}


def table(ids):
    return pa.table({"piece": pa.array(list(ids), pa.string()), "id": pa.array(list(ids.values()), pa.int32())})


@pytest.mark.parametrize("n", [0, 1, 7, 60, 3_000])
def test_longest_pieces(n):
    rng = random.Random(n)
    ids = vocabulary(rng, n)
    trie = Trie.of(table(ids))
    words = ["".join(rng.choices(LETTERS, k=rng.randrange(15))) for _ in range(400)] + ["##ab", "b" * 3_000]
    for subword in (True, False):
        flat, bounds = trie.split(pa.array(words), subword)
        assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [greedy(w, ids, subword) for w in words]
    texts = [" ".join(rng.choices(words, k=rng.randrange(6))) for _ in range(50)] + [None, ""]
    got, starts = trie.encode(pa.array(texts).slice(2), True)
    each = [[greedy(w, ids, True) for w in t.split(" ")] if t else [] for t in texts[2:]]
    assert got.to_pylist() == [sum(found, []) for found in each]
    assert starts.to_pylist() == [[i == 0 for found in row for i in range(len(found))] for row in each]


def test_pieces_may_repeat_and_be_null():
    trie = Trie.of(pa.table({"piece": ["a", "a", None, "ab"], "id": pa.array([5, 6, 7, 8], pa.int32())}))
    assert trie.split(pa.array(["a", "ab", "b"]), False)[0].tolist() == [6, 8, 0]


def test_size_is_that_of_the_arrays():
    rng = random.Random(1)
    ids = {"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 12))): i for i in range(30_000)}
    assert Trie.of(table(ids)).size < 80 * len(ids)


@pytest.fixture(scope="module")
def encoded(spark):
    rng = random.Random(4)
    ids = dict.fromkeys(SPECIAL_PIECES, 0) | {p: i for p, i in vocabulary(rng, 40).items()}
    vocab = spark.createDataFrame([(p, i) for p, i in ids.items() if p not in SPECIAL_PIECES] + [(p, i) for i, p in enumerate(SPECIAL_PIECES)], "piece string, id int")
    words = ["".join(rng.choices("abcde", k=rng.randrange(1, 9))) for _ in range(60)]
    texts = [(n, " ".join(rng.choices(words, k=rng.randrange(40))) if n else None) for n in range(60)]
    df = spark.createDataFrame(texts, "id int, evnt string")
    return vocab, encode(df, vocab, subword=True, starts="starts")


def test_masks_by_starts_are_those_by_pieces(spark, encoded):
    vocab, rows = encoded
    chunks = pad_sequence(chunk_from_end(rows, size=10, starts="starts"), max_len=14, starts="starts")
    key = chunks.withColumn("row_key", F.concat_ws("/", "id", "chunk"))
    by_starts = mask_words(key, "row_key", 100, p=0.4, starts="starts")
    by_pieces = mask_words(decode(key, vocab), "row_key", 100, p=0.4)
    columns = ["row_key", "input_ids", "labels"]
    assert by_starts.select(columns).exceptAll(by_pieces.select(columns)).isEmpty() and by_starts.count() == by_pieces.count() > 60
    assert by_starts.filter("exists(labels, x -> x > 0)").count() > 20
    assert all(len(r.starts) == 14 == len(r.input_ids) for r in by_starts.collect())


@pytest.mark.parametrize("keep", ["head", "tail"])
def test_padding_cuts_flags_with_ids(encoded, keep):
    for r in pad_sequence(encoded[1].withColumn("was", F.col("starts")), max_len=12, keep=keep, starts="starts").collect():
        body = r.was[-10:] if keep == "tail" else r.was[:10]
        assert r.starts == [True, *body, *[True] * (11 - len(body))]


def test_flags_follow_ids_through_parts(encoded):
    rows = encoded[1].filter("id > 0")
    halves = F.posexplode(F.array(F.lit(0), F.lit(1)))
    cut = F.when(F.col("part") == 0, F.slice("input_ids", F.lit(1), F.lit(7))).otherwise(F.expr("slice(input_ids, 8, 10000)"))
    flags = F.when(F.col("part") == 0, F.slice("starts", F.lit(1), F.lit(7))).otherwise(F.expr("slice(starts, 8, 10000)"))
    parts = rows.select("*", halves.alias("part", "_")).select("id", "part", cut.alias("input_ids"), flags.alias("starts"))
    whole = chunk_from_end(rows.select("id", "input_ids", "starts"), size=6, starts="starts")
    again = chunk_parts_from_end(parts, "id", size=6, starts="starts")
    assert again.select(whole.columns).exceptAll(whole).isEmpty() and again.count() == whole.count()
