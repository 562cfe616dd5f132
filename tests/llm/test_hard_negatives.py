"""Hard negatives against all scores, and the early stop of the lists."""

import math

import numpy as np
import pytest

from strandline.llm import hard_negatives as hard

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, row string, block string"


def slow(rows):
    kept = []
    for vec_id, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    result = []
    order = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))
    for i, (vec_id, label, vector) in enumerate(kept):
        if vec_id is None or vec_id % 100:
            continue
        scored = [(sum(x * y for x, y in zip(vector, v)), o, own == label) for j, (o, own, v) in enumerate(kept) if j != i]
        for score, positive, _ in order([s for s in scored if s[2]])[:5]:
            fits = order([s for s in scored if not s[2] and 30 * score <= 100 * s[0] <= 90 * score])[:10]
            result += [(vec_id, positive, rank, negative, score, other) for rank, (other, negative, _) in enumerate(fits, 1)]
    return result


def rows_of(n, seed, width=8, odd=True):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(10, width))
    rows = []
    for i in range(n):
        label = int(draw.integers(10))
        vector = [float(np.float32(x)) for x in middle[label] * 0.3 + draw.normal(size=width) * 0.4]
        rows.append((i, vector, label, None, None, None))
    if odd:
        some = [float(x) for x in middle[2]]
        rows += [
            (500, None, 1, "", "", ""), (600, some, None, "", "", ""), (700, [*some[:-1], math.nan], 1, "", "", ""),
            (800, [*some[:-1], None], 1, "", "", ""), (900, [math.inf, *some[1:]], 1, "", "", ""), (None, some, 2, "", "", ""),
            (None, some, 3, "", "", ""), (1000, some[:5], 2, "", "", ""), (1001, some + [1.0, 2.0], 2, "", "", ""), (1100, [], 4, "", "", ""),
            (1200, [0.0] * width, 5, "", "", ""), rows[0], rows[3], (1003, rows[3][1], 7, "", "", ""),
        ]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 64, "block_rows": 2}])
def test_same_as_all_scores(spark, sizes, monkeypatch):
    monkeypatch.setattr(hard, "LEAST_ROWS", 16)
    rows = rows_of(420, 1)
    got = hard.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = slow(rows)
    assert len(want) > 100 and sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_ties_and_equal_vectors(spark):
    rows = [(i, [0.5, 0.25], i % 3, None, None, None) for i in range(40)] + [(100 + i, [0.25, 0.25 * (i % 2)], 1 + i % 2, "", "", "") for i in range(30)]
    got = hard.hard_negatives(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(slow(rows)) != []


def test_nothing(spark):
    assert hard.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard.hard_negatives(spark.createDataFrame([(100, [1.0], 1, "", "", "")], SCHEMA)).count() == 0


def lists_of(vectors):
    n = len(vectors)
    return hard.SortedLists.of(np.arange(n), np.arange(n), np.arange(n) % 2, np.asarray(vectors, float))


def test_lists_are_left_early():
    """With few dimensions and a clear order the threshold stops the reading, and the answer is that of all rows."""
    draw = np.random.default_rng(4)
    lists = lists_of(np.floor(draw.exponential(size=(4_000, 2)) * 100))
    allowed = np.ones(4_000, bool)
    for anchor in ([5.0, 3.0], [2.0, -1.0], [-1.0, -4.0]):
        anchor = np.array(anchor)
        scores = (lists.vectors @ anchor).astype(int)
        high = int(np.sort(scores)[-200])
        spans = [hard.Span(None, None, 5), hard.Span(high - 50, high, 10), hard.Span(10**9, 10**9, 3), hard.Span(5, 4, 3)]
        found, depth = hard.first_rows(lists, anchor, allowed, spans)
        assert depth < 4_000
        for span, (place, score) in zip(spans, found):
            inside = [i for i in np.lexsort((np.arange(4_000), -scores)) if span.inside(scores[i : i + 1])[0]][: span.k]
            assert place.tolist() == inside and score.tolist() == scores[inside].tolist()


def test_ties_at_the_threshold_are_read():
    """A threshold equal to the last score doesn't stop, as an unseen row of a smaller id may tie."""
    vectors = np.zeros((400, 2))
    vectors[:, 0] = 7
    found, depth = hard.first_rows(lists_of(vectors), np.array([1.0, 1.0]), np.ones(400, bool), [hard.Span(None, None, 5)])
    assert depth == 400 and found[0][0].tolist() == [0, 1, 2, 3, 4]


def test_large_components_are_exact():
    vectors = np.array([[2.0**40, 1.0], [2.0**40, 3.0], [1.0, 1.0]])
    found, _ = hard.first_rows(lists_of(vectors), np.array([2.0**20 + 1, 1.0]), np.ones(3, bool), [hard.Span(None, None, 2)])
    assert found[0][1].tolist() == [2**60 + 2**40 + 3, 2**60 + 2**40 + 1]
