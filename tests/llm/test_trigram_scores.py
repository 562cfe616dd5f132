"""The registered query scores with trigrams, and packed arrays are read back as they were."""

import numpy as np
import pytest

from strandline.llm import lm_score


def test_shuffled_bigrams_score_lower(spark):
    """The first text has only known bigrams but no known trigram, the last one known trigrams too."""
    rows = list(enumerate(["a b c", "a b", "a b", "b c", "b c", "p q r", "p q r"]))
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    got, bigrams = ({r.doc_id: r.log_score for r in lm_score.lm_scores(documents, *o).collect()} for o in ((), (2,)))
    assert got[0] == pytest.approx(bigrams[0] + np.log(lm_score.BACKOFF))
    assert got[6] == pytest.approx(bigrams[6])


@pytest.mark.parametrize("size", [1, 2, 1000])
def test_packed(size):
    draw = np.random.default_rng(size)
    keys = np.unique(draw.integers(0, 2**64, size, np.uint64, endpoint=False) >> np.uint64(size % 7))
    assert np.array_equal(lm_score.unpacked_keys(np.frombuffer(lm_score.packed_keys(keys), np.uint8)), keys)
    extra = np.where(draw.random(size) < 0.2, draw.integers(1, 2**40, size), 0)
    assert np.array_equal(lm_score.unpacked_extra(np.frombuffer(lm_score.packed_extra(extra), np.uint8), size), extra)
