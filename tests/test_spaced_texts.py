"""White space and word counts in Arrow batches are those of the column functions."""

from collections import Counter
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from strandline.functions.text import spaced, spaced_texts, spaced_words, text_slices
from strandline.operators import vocabulary

SPACES = [chr(i) for i in range(0x3100) if i < 0x21 or chr(i).isspace() or i in (0x85, 0x180E, 0x200B, 0x2060)]
TEXTS = [None, "", " ", "a", " a  b ", "\n\n", "a　 \tb\r\n", "é é é　é", "한 한", *[f"x{c}y {c}z{c}{c} w{c}" for c in SPACES]]


def test_white_space(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    want = [r[1] for r in sorted(docs.select("i", spaced(F.col("text"))).collect())]
    assert spaced_texts(pa.array(TEXTS)).to_pylist() == want


def test_slices():
    texts = pa.array(["a" * 5, None, "b" * 30, "", "c", "d" * 9])
    parts = text_slices(texts, 10)
    assert [t for part in parts for t in part.to_pylist()] == texts.to_pylist() and len(parts) > 2
    assert [part.to_pylist() for part in text_slices(pa.array([], pa.string()), 10)] == [[]]


def test_word_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string").repartition(2)
    words = docs.select(F.explode(spaced_words(F.col("text"))).alias("w")).collect()
    want = Counter(unicodedata.normalize("NFC", r.w) for r in words)
    for size in (20, 8 << 20):
        monkeypatch.setattr(vocabulary, "COUNTED_BYTES", size)
        assert dict(map(tuple, vocabulary.word_counts(docs, "text").collect())) == want


def test_a_row_for_a_word_of_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b a é"] * 1000)], ["text"])
    assert sum(part.num_rows for part in vocabulary._count_words(iter([batch]))) == 3
