"""A batch of many texts is encoded a few texts at a time."""

import random
import tracemalloc

import pyarrow as pa

from strandline.operators import encoding
from strandline.operators.trie import Trie

VOCABULARY = pa.table({"piece": [f"w{n}" for n in range(5_000)] + ["w", "##1", "##2", "é"], "id": list(range(5, 5_009))})


def _texts(n: int) -> pa.Array:
    draw = random.Random(4)
    texts = [" ".join(f"w{draw.randrange(6_000)}" for _ in range(draw.choice([0, 1, 300]))) for _ in range(n)]
    return pa.array([*texts, None, "", "e\u0301 w12", "x" * 70_000])


def test_slices_give_what_one_batch_gives(monkeypatch):
    trie, texts = Trie.of(VOCABULARY), _texts(300)
    for subword in (False, True):
        whole = encoding.encode_batch(trie, texts, subword)
        for size in (1, 700, 1 << 14):
            monkeypatch.setattr(encoding, "SLICE_BYTES", size)
            assert encoding.encode_batch(trie, texts, subword).equals(whole)
            assert encoding.encode_batch(trie, texts[5:40], subword).to_pylist() == whole[5:40].to_pylist()
        monkeypatch.undo()
    assert len(encoding.encode_batch(trie, texts[:0], True)) == 0


def test_what_a_batch_needs_is_bounded(spark):
    """Before, a batch of 14 MB took all its arrays at once, 106 MB by numpy."""
    trie, texts = Trie.of(VOCABULARY), pa.concat_arrays([_texts(3_000)] * 8)
    encode_texts = encoding._encoder(type("Lookup", (), {"value": trie}), False).func
    tracemalloc.start()
    assert sum(map(len, encode_texts([texts]))) == len(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20, peak
