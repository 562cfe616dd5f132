"""The near-copy stage against brute-force similarity of five-word shingles."""

import random

import pytest
from odd_rows import none, odd  # noqa: F401

import corpus_pipeline
from strandline.llm import similar, simhash


def slow_shingles(text: str | None) -> set[str]:
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_pairs(texts: dict) -> set[tuple]:
    sets = {key: slow_shingles(text) for key, text in texts.items()}
    keys = list(texts)
    pairs = ((a, b) for n, a in enumerate(keys) for b in keys[n + 1 :])
    return {(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def reached(keys, pairs) -> dict:
    label = {key: n for n, key in enumerate(keys)}
    for _ in range(len(label)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label


@pytest.fixture(scope="module")
def edited():
    """Texts with some words replaced, so that similarities lie on both sides of 0.8, and a line that many texts have."""
    draw = random.Random(31)
    line, texts = " ".join(f"line{n}" for n in range(14)), []
    for base in range(16):
        words = [f"w{draw.randrange(3000)}" for _ in range([12, 60, 120, 300][base % 4])]
        for copy in range(9):
            new = list(words)
            for _ in range(draw.randint(0, max(1, len(words) // 40))):
                new[draw.randrange(len(new))] = f"n{draw.randrange(10**6)}"
            texts.append(" ".join(new) + (" " + line if copy % 2 else ""))
    return dict(enumerate(dict.fromkeys([*texts, "", "one", "one two", "A b c d", "a b  c d", line])))


@pytest.mark.parametrize("crowd", [1, 4, 200])
def test_similar_pairs(spark, edited, crowd, monkeypatch):
    """All pairs without crowds, and with them true pairs that connect the same texts."""
    monkeypatch.setattr(similar, "COMMON", 1 if crowd == 4 else 4)
    rows = spark.createDataFrame(list(edited.items()), "node bigint, text string").repartition(5)
    got = {(r.a, r.b) for r in similar.similar_links(rows, crowd).collect()}
    want = slow_pairs(edited)
    prints = {key: simhash.fingerprint(text) for key, text in edited.items()}
    assert sum((prints[a] ^ prints[b]).bit_count() > 3 for a, b in want) > 50
    assert got <= want and (got == want or crowd < 200)
    assert reached(edited, got) == reached(edited, want)
    few = {(r.a, r.b) for r in similar.similar_links(rows, crowd, connecting=True).collect()}
    assert few <= got and reached(edited, few) == reached(edited, want)


def test_a_group_is_not_compared_all_with_all(spark):
    """Of 60 near copies each is compared once; a text that only resembles some of them is found too."""
    draw = random.Random(8)
    base = [f"w{n}" for n in range(200)]
    texts = [" ".join([*base[:n], "new", *base[n:]]) for n in draw.sample(range(200), 60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    links = similar.similar_links(rows, connecting=True).collect()
    assert len(links) < 2 * len(texts) and set(reached(range(60), [tuple(r) for r in links]).values()) == {0}


def test_stage_keeps_one_of_similar(spark, edited):
    """Each connected group keeps its smallest id; the stage took 3 bits of three-word fingerprints before."""
    rows = spark.createDataFrame(list(edited.items()), "doc_id bigint, text string")
    label = reached(edited, slow_pairs(edited))
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, rows, "").collect())
    assert got == sorted(set(label.values()))


def test_similar_odd_rows(odd, none):
    kept = similar.keep_one_of_similar(odd)
    assert kept.columns == odd.columns
    rows = {n: r.text for n, r in enumerate(sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)))}
    assert kept.count() == len(set(reached(rows, slow_pairs(rows)).values()))
    assert similar.keep_one_of_similar(none).count() == 0


def test_similar_rows_with_null_ids(spark):
    """Equal ids of different texts, and equal texts with null ids."""
    long = "the quick brown fox jumps over a lazy dog near the old river bank at noon"
    rows = [(None, long), (2, long), (None, "clean one"), (2, "clean two"), (None, long), (9, f"{long} .")]
    frame = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id bigint, text string, n int")
    kept = similar.keep_one_of_similar(frame)
    assert sorted(r.n for r in kept.collect()) == [0, 2, 3]


def test_sketches_leave_no_similar_pair_out():
    draw = random.Random(5)
    for _ in range(300):
        words = [f"w{draw.randrange(500)}" for _ in range(draw.randint(1, 200))]
        new = [f"n{n}" if draw.random() < 0.02 else word for n, word in enumerate(words)]
        a, b = (similar.shingles(" ".join(w)) for w in (words, new))
        apart = (similar.sketch(a) ^ similar.sketch(b)).tobytes()
        assert sum(byte.bit_count() for byte in apart) <= len(set(a) ^ set(b))
        fine = similar.apart(similar.fine_sketch(a), similar.fine_sketch(b))
        assert fine <= len(set(a) ^ set(b)) and fine >= similar.apart(similar.sketch(a), similar.sketch(b))


def test_fine_sketches_fold():
    """A wider sketch folded is the narrower one, and it tells sets apart that the 512 bits don't."""
    a, b = (similar.shingles(" ".join(f"{name}{n % 700 if n < 700 else n}" for n in range(2_000))) for name in "ab")
    assert similar.apart(similar.fine_sketch(a), similar.sketch(a)) == 0
    assert 9 * similar.apart(similar.fine_sketch(a), similar.fine_sketch(b)) > len(a) + len(b)
    assert 9 * similar.apart(similar.sketch(a), similar.sketch(b)) <= len(a) + len(b)
