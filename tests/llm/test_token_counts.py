"""Token counts against the library that reads the same vocabulary file."""

import random

import public_tokenizers
import pytest
from conftest import SF
from odd_rows import none, odd  # noqa: F401

from strandline.llm import token_count

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> c", "<|endoftext|", "it's 've''ll", "x" * 30_000, "ab" * 5_000,
    " " * 999, " \t\n  x  \n", "aaa՘Ᲊ ᲉᲉ1", "\U00016d40\U00016d41 1\U0001ccf0\U0001ccf1", "é" * 50 + "가나다 12３４",
]


@pytest.fixture(scope="module")
def vocabulary():
    return token_count.Vocabulary.load(FILE)


@pytest.fixture(scope="module")
def library():
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(FILE)
    return lambda texts: [len(found.ids) for found in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_same_as_the_library(spark, vocabulary, library):
    draw = random.Random(1)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    for _ in range(1_500):
        codes = [draw.choice([draw.randrange(32, 127), draw.randrange(0xA0, 0x600), draw.randrange(0xD7FF), draw.randrange(0xE000, 0x110000), 32, 39]) for _ in range(draw.randrange(50))]
        texts.append("".join(map(chr, codes)))
    counter = token_count.Counter(vocabulary)
    assert [counter.count(text) for text in texts] == library(texts)


def test_forgotten_words_are_counted_again(vocabulary, library):
    texts = [f"word{n} other{n * 7}" for n in range(60)] * 2
    counter = token_count.Counter(vocabulary, kept_words=5)
    assert [counter.count(text) for text in texts] == library(texts)


def test_merges_by_rank_then_from_the_left():
    a, b, ab, aa = range(4)
    pair = lambda x, y: x << 24 | y
    symbols = [a if byte == ord("a") else b for byte in range(256)]
    made = token_count.Vocabulary({pair(a, a): 0, pair(a, b): 1}, [aa, ab], symbols, (), "")
    for word, merges in ((b"", 0), (b"a", 0), (b"aaab", 2), (b"aab", 1), (b"aaaa", 2), (b"abab", 2), (b"bbb", 0)):
        assert token_count.count_merges(word, made) == merges


def test_table(spark, odd, none, vocabulary, library):  # noqa: F811
    counts = token_count.with_limit(token_count.token_counts(odd, vocabulary), 100)
    assert counts.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted([tuple(r) for r in counts.collect()], key=str)
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    sizes = library([text for _, text in texts])
    assert got == sorted([(i, len(t.encode()), n, n > 100) for (i, t), n in zip(texts, sizes)], key=str)
    assert token_count.token_counts(none, vocabulary).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="not a plain"):
        token_count.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))
