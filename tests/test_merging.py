"""Merges that are kept up by what changes."""

import random
from collections import Counter

import pytest
from test_vocabulary import corpus, one_at_a_time  # noqa: F401

from strandline.constants import SPECIAL_PIECES
from strandline.operators import vocabulary
from strandline.operators.merging import Shard, finish, first_pieces, triples
from strandline.operators.vocabulary import train_wordpiece


def words(seed, n=300):
    rng = random.Random(seed)
    parts = ["ab", "b", "ba", "aab", "가나", "x", "aaa", "é"]
    return Counter("".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(n))


def test_counts_follow_the_words():
    found = words(1)
    shard = Shard(list(found), list(found.values()))
    counts = shard.counts()
    for pairs in ({("a", "##b")}, {("##a", "##a"), ("b", "##a")}, {("##aa", "##b"), ("x", "##x")}, {("ab", "##b"), ("가", "##나")}):
        before, touched = list(shard.words), shard.touched
        having = {i for i, w in enumerate(before) if any(f" {a} {b} " in f" {w} " for a, b in pairs)}
        assert having <= set(shard.having(pairs))
        counts.update(shard.merge(pairs))
        changed = {i for i, (a, b) in enumerate(zip(before, shard.words)) if a != b}
        assert changed <= having and shard.touched - touched <= len(having) + 5
        fresh = Counter()
        for word, freq in zip(shard.words, shard.freqs.tolist()):
            for triple in triples(word.split(" ")):
                fresh[triple] += freq
        assert {t: n for t, n in counts.items() if n} == dict(fresh)
        assert shard.pieces_left() == sum(len(w.split(" ")) for w in shard.words if " " in w)


def test_words_without_the_pair_are_not_read():
    shard = Shard(["abc", "xyz", "abx"] + [f"q{'r' * n}" for n in range(1, 50)], [1] * 52)
    shard.merge({("a", "##b")})
    assert shard.touched == 2 and shard.words[1] == "x ##y ##z"
    shard.merge({("ab", "##c")})
    assert shard.touched == 3 and shard.words[0] == "abc"


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("room, bar", [(10**6, 3), (12, 3), (0, 3)])
def test_finish_is_one_at_a_time(seed, room, bar):
    found = words(seed)
    got = finish([first_pieces(w) for w in found], list(found.values()), {}, room, bar)
    alphabet = len({p for w in found for c in w for p in (c, "##" + c)})
    want = one_at_a_time(found, 10**6, bar)
    made = {p: n for p, n in want.items() if len(p.removeprefix("##")) > 1}
    if room > 100:
        assert dict(got) == made
    elif room:
        assert [p for p, _ in got][:room] == list(made)[:room] and alphabet
        assert all(n == got[room - 1][1] for _, n in got[room:])
    else:
        assert got == []


@pytest.mark.parametrize("vocab_size", [10**6, 90])
@pytest.mark.parametrize("small, pairs, compact", [(0, 20_000, 8), (0, 7, 2), (2_500, 20_000, 3)])
def test_rounds_give_what_one_at_a_time_gives(spark, corpus, monkeypatch, vocab_size, small, pairs, compact):  # noqa: F811
    monkeypatch.setattr(vocabulary, "ROUND_PAIRS", pairs)
    monkeypatch.setattr(vocabulary, "COMPACT_ROUNDS", compact)
    if pairs == 7 and vocab_size > 90:
        pytest.skip("one after the other takes long")
    df = spark.createDataFrame([(t,) for t in corpus], "evnt string")
    got = train_wordpiece(df, vocab_size=vocab_size, min_frequency=5, small=small).collect()
    want = one_at_a_time(Counter(w for t in corpus for w in t.split()), vocab_size, 5)
    assert {r.piece: r.freq for r in got if r.piece not in SPECIAL_PIECES} == want


def test_no_words(spark):
    df = spark.createDataFrame([("",), (None,), ("a b",)], "evnt string")
    for small in (0, 100):
        assert {r.piece for r in train_wordpiece(df, min_frequency=1, small=small).collect()} == {*SPECIAL_PIECES, "a", "b"}
