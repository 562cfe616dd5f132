"""Scoring with a caller's model, and two baselines for the tasks the sequences serve."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.constants import N_CLASSES, TAIL_WORDS
from strandline.functions.text import words
from strandline.operators.label_model import HASH_BITS, LabelModel, fit
from strandline.sources.shared import stored


def score(df: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Score rows in Arrow batches; ``make_scorer`` loads the model once per task."""

    def score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            yield scorer(batch)

    return df.mapInPandas(score_batches, schema)


def fit_labels(
    train: DataFrame, text: str = "x", y: str = "y", n_classes: int = N_CLASSES, hash_bits: int = HASH_BITS, max_iter: int = 20
) -> LabelModel:
    """A logistic regression for each class on word counts, all in the same passes; see ``label_model``.

    Words are hashed to 2 ** ``hash_bits`` features, so none is left out, however many there are.
    """
    return fit(train, text, y, n_classes, hash_bits, max_iter)


def predict_labels(model: LabelModel, df: DataFrame, n_classes: int = N_CLASSES, text: str = "x") -> DataFrame:
    """Add arrays ``probs`` and ``preds``, one entry per class."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def probabilities(texts: pa.Array) -> pa.Array:
        found = shared.value.probabilities(texts)[:, :n_classes]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * n_classes, pa.int32()), pa.array(found.ravel()))

    scored = df.withColumn("probs", probabilities.asNondeterministic()(text))
    return scored.withColumn("preds", F.transform("probs", lambda p: (p > 0.5).cast("int")))


def next_event_model(train: DataFrame, key: str, text: str = "evnt", part: str = "part") -> DataFrame:
    """Rows (prev, next, n): the event that most often follows, ties to the smaller text.

    The last event of a part is followed by the first of the next one, so a sequence counts alike in one part or many.
    """
    split = train.select(key, part, words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    follows = F.zip_with(
        F.slice("w", 1, F.size("w") - 1),
        F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("prev"), b.alias("next")),
    )
    pairs = split.select(F.inline(follows))
    ends = split.select(key, part, F.get("w", 0).alias("__head"), F.get("w", F.size("w") - 1).alias("prev"))
    following = F.lead("__head").over(Window.partitionBy(key).orderBy(part))
    pairs = pairs.unionByName(ends.select("prev", following.alias("next")).filter("next is not null"))
    counts = pairs.groupBy("prev", "next").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("next")))
    return counts.groupBy("prev").agg(best.alias("b")).select("prev", F.col("b.next"), (-F.col("b.less")).alias("n"))


def fill_next(model: DataFrame, df: DataFrame, history: str = "history", n: int = TAIL_WORDS) -> DataFrame:
    """Add ``preds``: the n events the model expects after the history, null once it knows none.

    The chains are made on the model, one row per event, so the histories are joined once. The model is stored, or
    each step of a chain would count the bigrams again. Of a history in several parts, hand over the last one.
    """
    model = stored(model, "next-events")
    step = model.select(F.col("prev").alias("__at"), F.col("next").alias("__to"))
    chains = model.select("prev", F.array("next").alias("preds"))
    for i in range(1, n):
        chains = chains.join(step, F.get("preds", i - 1) == F.col("__at"), "left").select(
            "prev", F.concat("preds", F.array("__to")).alias("preds")
        )
    rows = df.withColumn("prev", F.substring_index(F.col(history), " ", -1))
    unknown: Column = F.array_repeat(F.lit(None).cast("string"), n)
    return rows.join(chains, "prev", "left").withColumn("preds", F.coalesce("preds", unknown)).drop("prev")
