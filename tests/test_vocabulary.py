"""Subword training against one merge at a time, and against a published library."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.constants import SPECIAL_PIECES
from strandline.operators.encoding import encode
from strandline.operators.vocabulary import train_wordpiece, word_counts, word_vocabulary


def one_at_a_time(words, vocab_size, min_frequency):
    words = [[[w[0], *("##" + c for c in w[1:])], n] for w, n in words.items()]
    pieces = Counter()
    for ps, n in words:
        for p in ps:
            pieces[p] += n
            pieces[p.removeprefix("##") if len(p) > 2 else p] += 0
    while len(pieces) + len(SPECIAL_PIECES) < vocab_size:
        pairs = Counter()
        for ps, n in words:
            for pair in zip(ps, ps[1:]):
                pairs[pair] += n
        best = min(((-n, pair) for pair, n in pairs.items() if n >= min_frequency), default=None)
        if best is None:
            break
        pair = best[1]
        pieces.setdefault(pair[0] + pair[1][2:], -best[0])
        for word in words:
            old, new = word[0], []
            for p in old:
                if new and (new[-1], p) == pair:
                    new[-1] += p[2:]
                else:
                    new.append(p)
            word[0] = new
    return dict(pieces)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    parts = ["shop", "bank", "가게", "은행", "pay", "ment", "s", "aa", "ab", "ing", "er", "1", "24"]
    words = ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(600)]
    return [" ".join(rng.choices(words, k=12)) for _ in range(300)]


@pytest.mark.parametrize("vocab_size", [10**6, 90])
def test_same_as_one_merge_at_a_time(spark, corpus, vocab_size):
    df = spark.createDataFrame([(t,) for t in corpus], "evnt string")
    got = train_wordpiece(df, vocab_size=vocab_size, min_frequency=5).collect()
    want = one_at_a_time(Counter(w for t in corpus for w in t.split()), vocab_size, 5)
    assert {r.piece: r.freq for r in got if r.piece not in SPECIAL_PIECES} == want
    order = sorted(want, key=lambda p: (-want[p], p))
    assert {r.piece: r.id for r in got} == {p: i for i, p in enumerate([*SPECIAL_PIECES, *order])}


def test_pieces_and_encodings_match_the_library(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import models, normalizers, pre_tokenizers, trainers

    df = spark.createDataFrame([(t,) for t in corpus], "evnt string")
    vocab = train_wordpiece(df, min_frequency=5)
    ours = {r.piece: r.id for r in vocab.collect()}

    library = tokenizers.Tokenizer(models.WordPiece(unk_token="[UNK]"))
    library.normalizer, library.pre_tokenizer = normalizers.NFC(), pre_tokenizers.WhitespaceSplit()
    library.train_from_iterator(
        corpus,
        trainers.WordPieceTrainer(
            vocab_size=10**6, min_frequency=5, special_tokens=list(SPECIAL_PIECES), limit_alphabet=10**6, show_progress=False
        ),
    )
    theirs = set(library.get_vocab())
    assert len(theirs ^ set(ours)) <= 0.1 * len(theirs)  # equal counts are merged in another order

    same = tokenizers.Tokenizer(models.WordPiece(ours, unk_token="[UNK]", max_input_chars_per_word=10**6))
    same.normalizer, same.pre_tokenizer = normalizers.NFC(), pre_tokenizers.WhitespaceSplit()
    texts = corpus[:100] + ["unseen shopX 가나 " + "s" * 120]
    rows = encode(spark.createDataFrame(list(enumerate(texts)), "id int, evnt string"), vocab, subword=True).collect()
    assert {r.id: r.input_ids for r in rows} == {i: same.encode(t).ids for i, t in enumerate(texts)}


def test_alphabet_limit_drops_rare_characters(spark):
    df = spark.createDataFrame([("aab aab",), ("xab",)], "evnt string")
    got = {r.piece for r in train_wordpiece(df, min_frequency=100, limit_alphabet=2).collect()}
    assert got == {*SPECIAL_PIECES, "a", "b", "##a", "##b"}


def test_normal_form_is_c(spark):
    df = spark.createDataFrame([("éa éa",)], "evnt string")
    assert "é" in {r.piece for r in train_wordpiece(df, min_frequency=1).collect()}


def test_word_counts_and_caps(spark):
    df = spark.createDataFrame([("b a  a\nc b a",), (None,)], "evnt string")
    assert {tuple(r) for r in word_counts(df, min_frequency=2).collect()} == {("a", 3), ("b", 2)}
    assert [r.word for r in word_counts(df, limit=1).collect()] == ["a"]
    assert {r.piece for r in word_vocabulary(df, min_frequency=1, max_size=7).collect()} == {*SPECIAL_PIECES, "a", "b"}


def test_ids_have_no_gaps(spark, corpus):
    df = spark.createDataFrame([(t,) for t in corpus], "evnt string")
    ids = sorted(r.id for r in word_vocabulary(df, min_frequency=1).collect())
    assert ids == list(range(len(ids)))
    assert word_vocabulary(df, min_frequency=1).filter(F.col("freq").isNull()).count() == len(SPECIAL_PIECES)
