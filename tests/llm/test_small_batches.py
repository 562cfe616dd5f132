"""What a task holds outside the heap is bounded, whatever the size of a batch."""

import numpy as np
import pyarrow as pa
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import decontaminate


def test_counts_hold_a_few_texts(monkeypatch):
    monkeypatch.setattr(decontaminate, "COUNTED_WORDS", 20)
    items = decontaminate.Items.of([(1, "a b c d")])
    texts = ["a b c d " * 3, None, "", "b c " * 30, "d", "x a b"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(decontaminate._few_at_once(items, iter([batch, batch])))
    want = np.concatenate([part for text in texts * 2 for part in (items.numbers(text), [-1])])
    assert np.concatenate(parts).tolist() == want.tolist()
    assert max(map(len, parts)) <= 19 + 61  # a long text, and what was held before it
    assert list(decontaminate._few_at_once(items, iter([]))) == []


def test_a_stage_by_itself_has_small_batches(spark):
    """The check tool calls stages, not the entry."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    try:
        for _, stage in corpus_pipeline.STAGES[3:]:
            spark.conf.set(key, 64 << 20)
            stage(spark, docs, SF)
            assert int(spark.conf.get(key)) == corpus_pipeline.ARROW_BYTES
    finally:
        spark.conf.set(key, before)


def test_dropped_texts_in_a_shuffle_or_told(spark, monkeypatch):
    docs = spark.range(40).select("id", F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six "), F.col("id") % 3).alias("text"))
    docs = docs.withColumn("text", F.when(F.col("id") % 2 == 0, F.col("text")))
    benchmark = spark.createDataFrame([(1, "one two three four five six 1")], "item_id bigint, text string")
    told = decontaminate.drop_contaminated(docs, benchmark)
    assert "BroadcastHashJoin" in told._jdf.queryExecution().toString()
    monkeypatch.setattr(decontaminate, "TOLD_TEXTS", 0)
    shuffled = decontaminate.drop_contaminated(docs, benchmark)
    rows = [sorted(map(tuple, df.collect())) for df in (told, shuffled)]
    assert rows[0] == rows[1] == [(i, i, None) for i in range(1, 40, 2)]
