"""Rows with null and repeated ids are dropped one by one, each for its own text."""

from strandline.llm import decontaminate, exact_dedup

LONG = "the quick brown fox jumps over a lazy dog near the old river bank at noon"
SCHEMA = "doc_id bigint, text string, n int"


def texts_of(df):
    return sorted((r.text or "" for r in df.collect()))


def test_exact_rows_with_null_ids(spark):
    rows = [(None, "ab c"), (5, "abc"), (None, "x"), (7, "x "), (None, "clean"), (7, "other"), (8, "x"), (7, "other  one")]
    kept = exact_dedup.drop_exact_duplicates(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], SCHEMA))
    assert texts_of(kept) == sorted(["ab c", "x ", "clean", "other", "other  one"])


def test_exact_rows_that_agree(spark):
    """Of rows with the same id and text one stays, null ids and texts too."""
    rows = [(None, "same"), (None, "same"), (3, "twice"), (3, "twice"), (None, None), (None, ""), (4, "once")]
    kept = exact_dedup.drop_exact_duplicates(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], SCHEMA))
    assert sorted((r.n for r in kept.collect())) == [0, 2, 4, 6]


def test_contaminated_rows(spark):
    rows = [(None, f"see {LONG} end"), (None, "clean one"), (6, LONG), (6, "clean two"), (7, None), (None, None)]
    documents = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], SCHEMA)
    benchmark = spark.createDataFrame([(1, LONG)], "item_id bigint, text string")
    assert sorted(r.n for r in decontaminate.drop_contaminated(documents, benchmark).collect()) == [1, 3, 4, 5]


def test_rows_with_maps(spark):
    """A column without an order doesn't matter, repeated rows or not."""
    rows = [(1, "same", {"a": 1}), (1, "same", {"b": 2}), (2, "same", None), (3, "other", {})]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, more map<string, int>")
    kept = exact_dedup.drop_exact_duplicates(documents)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == documents.columns
