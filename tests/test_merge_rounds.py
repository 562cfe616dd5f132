"""Rounds over shards in memory, in one task and in several that wait for each other."""

import random
import threading
from collections import Counter

import numpy as np
import pytest
from test_merging import words as words_of
from test_vocabulary import corpus, one_at_a_time  # noqa: F401

from strandline.constants import SPECIAL_PIECES
from strandline.operators import vocabulary
from strandline.operators.merge_rounds import LinkedWords, merge_rounds
from strandline.operators.merging import NumberedWords, PieceNumbers, joined
from strandline.operators.vocabulary import train_wordpiece


def _words(seed, n=500):
    draw = random.Random(seed)
    parts = ["ab", "b", "aaa", "가나", "x", "#", "##", "é", "😀", "ing"]
    return Counter("".join(draw.choices(parts, k=draw.randrange(1, 6))) for _ in range(n))


def _numbered(words):
    return NumberedWords.of(list(words), list(words.values()))


@pytest.mark.parametrize("seed", range(5))
def test_linked_words_are_numbered_words(seed):
    plain = _numbered(_words(seed))
    linked, numbers = LinkedWords(plain.pieces, plain.freqs), PieceNumbers()
    counts = Counter(dict(zip(*(part.tolist() for part in plain.counts()))))
    for _ in range(12):
        ranked = np.array(sorted(counts, key=lambda k: (-counts[k], k))[:40], np.int64)
        if not len(ranked):
            break
        beaten = linked.rank(ranked)
        assert np.flatnonzero(beaten).tolist() == plain.beaten(ranked).tolist()
        new = [-1 if b else numbers.number(joined(numbers.text(k >> 32), numbers.text(k & 0xFFFFFFFF))) for k, b in zip(ranked.tolist(), beaten)]
        new = np.array(new, np.int32)
        order = np.argsort(ranked[~beaten])
        want = dict(zip(*(part.tolist() for part in plain.merge(ranked[~beaten][order], new[~beaten][order]))))
        assert dict(zip(*(part.tolist() for part in linked.merge(new)))) == want
        counts.update(want)
        counts = Counter({key: n for key, n in counts.items() if n})
        assert {k: n for k, n in zip(*(part.tolist() for part in linked.all_counts())) if n} == counts
        assert linked.left == plain.pieces_left()
    pieces, freqs = linked.rest()
    assert pieces.tolist() == plain.pieces.tolist() and freqs.tolist() == plain.freqs.tolist()


@pytest.mark.parametrize("tasks", [1, 3])
@pytest.mark.parametrize("limit", [7, 1_000])
def test_tasks_agree_on_one_at_a_time(tasks, limit):
    words = words_of(1)
    shards = [[] for _ in range(tasks)]
    for number in range(4):
        share = _numbered(dict(list(words.items())[number::4]))
        shards[number % tasks].append(LinkedWords(share.pieces, share.freqs))
    told, made, meet = [None] * tasks, [{} for _ in range(tasks)], threading.Barrier(tasks, timeout=60)

    def run(task):
        def gather(value):
            told[task] = value
            meet.wait()
            found = list(told)
            meet.wait()
            return found

        assert merge_rounds(shards[task], gather, made[task], 10**6, 3, limit, 0)

    threads = [threading.Thread(target=run, args=(task,)) for task in range(tasks)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join(60)
    want = {piece: n for piece, n in one_at_a_time(words, 10**6, 3).items() if len(piece.removeprefix("##")) > 1}
    for found in made:
        assert {piece: n for piece, n in found.items() if len(piece.removeprefix("##")) > 1} == want


def test_rounds_store_no_state(spark, corpus, monkeypatch):  # noqa: F811
    """However many rounds there are; before, each stored all words."""
    names = []
    kept = vocabulary.stored
    monkeypatch.setattr(vocabulary, "stored", lambda df, name: names.append(name) or kept(df, name))
    df = spark.createDataFrame([(t,) for t in corpus], "evnt string")
    train_wordpiece(df, min_frequency=5, small=0).collect()
    assert names.count("subwords") == 1


@pytest.mark.parametrize("how, most", [("several tasks, then one", 2_500), ("jobs", 0)])
def test_more_words_than_one_task_holds(spark, corpus, monkeypatch, how, most):  # noqa: F811
    monkeypatch.setattr(vocabulary, "ROUND_PIECES", most)
    monkeypatch.setattr(vocabulary, "LINKED_PIECES", 500)
    monkeypatch.setattr(vocabulary, "ROUND_TASKS", 2)
    df = spark.createDataFrame([(t,) for t in corpus], "evnt string")
    got = train_wordpiece(df, vocab_size=90, min_frequency=5, small=0).collect()
    want = one_at_a_time(Counter(w for t in corpus for w in t.split()), 90, 5)
    assert {r.piece: r.freq for r in got if r.piece not in SPECIAL_PIECES} == want
