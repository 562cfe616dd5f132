"""The near-copy stage starts with SimHash; what it connects is exact, and the rest is found besides."""

import random

import corpus_pipeline
from strandline.llm import similar, simhash


def _texts():
    draw = random.Random(12)
    texts = []
    for _ in range(12):
        words = [f"w{draw.randrange(4000)}" for _ in range(600)]
        for copy in range(4):
            new = list(words)
            for _ in range(copy):
                new[draw.randrange(600)] = f"n{draw.randrange(10**6)}"
            texts.append(" ".join(new))
    return dict(enumerate([*texts, "", "one"]))


def test_fingerprints_are_the_first_step(spark, monkeypatch):
    """Every pair of the step is linked by fingerprints and similar; the stage hands it to the search by prefixes."""
    texts, handed = _texts(), []
    links_of, search = similar.fingerprint_links, similar.similar_links
    monkeypatch.setattr(similar, "similar_links", lambda *args, **named: handed.append(named["known"]) or search(*args, **named))
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, rows, "").collect())
    assert kept == [*range(0, 48, 4), 48, 49]
    named = {r.node: r.text for r in similar._texts(rows).collect()}
    found = {(r.a, r.b) for r in links_of(similar._texts(rows)).collect()}
    assert found and {(r.a, r.b) for r in handed[0].collect()} == found
    for a, b in found:
        x, y = (simhash.fingerprint(named[n]) for n in (a, b))
        assert ((x ^ y) & (1 << 64) - 1).bit_count() <= 3
        one, two = (set(similar.shingles(named[n]).tolist()) for n in (a, b))
        assert 5 * len(one & two) >= 4 * len(one | two)


def test_linked_fingerprints_of_other_texts_are_left_apart(spark):
    """Texts of the same words in different numbers may have near fingerprints; only similar sets count."""
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b c d e f"), (3, ""), (4, "\t ")], "node bigint, text string")
    assert {(r.a, r.b) for r in similar.fingerprint_links(rows).collect()} == {(3, 4)}
