"""Copies that keep only a stem which many documents have."""

from strandline.llm import decontaminate


def test_stem_in_many_documents(spark):
    """45 % of an item verbatim, and of the rest every third word replaced: 0.725 of the full score."""
    stem, rest = [f"stem{n}" for n in range(18)], [f"rest{n}" for n in range(22)]
    copy = stem + [f"new{n}" if n % 3 == 0 else word for n, word in enumerate(rest)]
    rows = [(0, " ".join(copy))] + [(n, " ".join(stem) + f" tail{n} of a clean document") for n in range(1, 80)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, " ".join(stem + rest))], "item_id bigint, text string")
    found = decontaminate.contaminations(documents, benchmark).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(0, 1)] and found[0].score >= decontaminate.THRESHOLD
