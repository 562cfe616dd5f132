"""Draws that are made for whole arrays in Python are those of the column functions."""

from pyspark.sql import functions as F

from strandline.functions.hashing import hit, hits
from strandline.operators.masking import mask_words


def test_hits(spark):
    rows = [("a", 3), ("b:c", 0), (None, 40), ("é", 200), ("x", None), ("", 7)]
    df = spark.createDataFrame(rows, "key string, n int").repartition(2)
    each = F.transform(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>")), lambda i: i)
    for share in (0.0, 0.1, 0.5, 1.0):
        one = F.when(F.col("n").isNotNull(), F.transform(each, lambda i: hit(share, 42, "token", F.col("key"), i)))
        both = df.select("key", one.alias("want"), hits(share, F.col("n"), 42, "token", F.col("key")).alias("got")).collect()
        assert len(both) == len(rows) and all(r.want == r.got for r in both)


def test_word_masks_draw_in_python(spark):
    df = spark.createDataFrame([(1, ["a", "##b"], [5, 6])], "doc_id int, pieces array<string>, input_ids array<int>")
    plan = mask_words(df, "doc_id", 2000)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan
