"""Words as arrays of numbers of pieces, against the plain form by text."""

import random
from collections import Counter

import numpy as np
import pytest

from strandline.operators.merging import NumberedWords, PieceNumbers, Shard, joined, pair_key


def _words(seed: int, n: int = 400) -> Counter:
    draw = random.Random(seed)
    parts = ["ab", "b", "aaa", "가나", "x", "#", "##", "é", "😀"]
    return Counter("".join(draw.choices(parts, k=draw.randrange(1, 6))) for _ in range(n))


def _as_text(numbers: PieceNumbers, words: NumberedWords) -> Counter:
    texts = Counter()
    for word, freq in zip(words.words(), words.freqs.tolist()):
        texts[" ".join(map(numbers.text, word))] += freq
    return texts


@pytest.mark.parametrize("seed", range(5))
def test_rounds_by_number_are_rounds_by_text(seed):
    found = _words(seed)
    numbers, words, plain = PieceNumbers(), NumberedWords.of(list(found), list(found.values())), Shard(list(found), list(found.values()))
    counts = Counter(dict(zip(*(part.tolist() for part in words.counts()))))
    for _ in range(12):
        ranked = sorted(counts, key=lambda k: (-counts[k], numbers.text(k >> 32), numbers.text(k & 0xFFFFFFFF)))[:40]
        if not ranked:
            break
        beaten = set(words.beaten(np.array(ranked, np.int64)).tolist())
        triples = plain.counts()
        name = lambda key: (numbers.text(key >> 32), numbers.text(key & 0xFFFFFFFF))
        place = {name(key): i for i, key in enumerate(ranked)}
        overlaps = [(place.get((a, b)), place.get((b, c))) for (a, b, c), n in triples.items() if n and a is not None]
        assert beaten == {max(p) for p in overlaps if None not in p and p[0] != p[1]}
        pairs = np.array(sorted(key for i, key in enumerate(ranked) if i not in beaten), np.int64)
        plain.merge({name(key) for key in pairs.tolist()})
        new = np.array([numbers.number(joined(*name(key))) for key in pairs.tolist()], np.int32)
        counts.update(dict(zip(*(part.tolist() for part in words.merge(pairs, new)))))
        counts = Counter({key: n for key, n in counts.items() if n})
        assert counts == Counter(dict(zip(*(part.tolist() for part in words.counts()))))
        left = Counter()
        for word, freq in zip(plain.words, plain.freqs.tolist()):
            if " " in word:
                left[word] += freq
        assert _as_text(numbers, words) == left
        assert words.pieces_left() == plain.pieces_left()


def test_a_state_takes_four_bytes_a_piece():
    found = _words(9, 3_000)
    words = NumberedWords.of(list(found), list(found.values()))
    assert len(words.pieces.tobytes()) == 4 * (words.pieces_left() + len(words.freqs))


def test_equal_texts_have_one_number():
    numbers = PieceNumbers()
    assert numbers.number(joined("a", "##bc")) == numbers.number(joined("ab", "##c"))
    assert numbers.number(joined("##", "##a")) == numbers.number("##a") == int(NumberedWords.of(["ba"], [1]).pieces[1])
    assert numbers.text(numbers.number("##ab")) == "##ab" and pair_key(1, 2) == (1 << 32) + 2


def test_words_of_one_letter_or_none():
    words = NumberedWords.of(["a", "b"], [3, 4])
    assert words.pieces_left() == 0 and words.words() == [] and len(words.counts()[0]) == 0
    assert len(words.beaten(np.array([pair_key(1, 2)]))) == 0 and len(words.merge(np.array([pair_key(1, 2)]), np.array([7]))[0]) == 0
