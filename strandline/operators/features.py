"""Bounded integer customer features."""

from pyspark.sql import DataFrame, functions as F

from strandline.constants import FEATURE_SIZES
from strandline.operators.events import join_codes


def shift_ids(df: DataFrame, meta_columns: list[str]) -> DataFrame:
    """Feature ids plus one as int, missing ones 0. Meta columns, labels too, stay as they are."""
    shifted = {
        c: F.coalesce(F.col(c) + F.lit(1), F.lit(0)).cast("int") for c in df.columns if c not in meta_columns
    }
    return df.withColumns(shifted)


def check_ids(df: DataFrame, sizes: dict[str, int] = FEATURE_SIZES) -> DataFrame:
    """Per feature: lowest and highest id, share of missing rows, ids its table does not have."""
    reports = [
        F.struct(
            F.lit(c).alias("feature"),
            F.min(c).cast("int").alias("min_id"),
            F.max(c).cast("int").alias("max_id"),
            F.avg((F.coalesce(F.col(c), F.lit(0)) == 0).cast("double")).alias("missing_rate"),
            F.count_if((F.col(c) < 0) | (F.col(c) >= size)).alias("out_of_range"),
        )
        for c, size in sizes.items()
    ]
    return df.agg(F.array(*reports).alias("r")).select(F.inline("r"))


def bucket_ids(df: DataFrame, col: str, edges: list[float], name: str) -> DataFrame:
    """1 below the first edge, 2 from the first edge on, and so on; 0 for null."""
    number = F.lit(len(edges) + 1)
    for i, edge in reversed(list(enumerate(edges, start=1))):
        number = F.when(F.col(col) < edge, F.lit(i)).otherwise(number)
    return df.withColumn(name, F.when(F.col(col).isNull(), F.lit(0)).otherwise(number).cast("int"))


def join_features(seq: DataFrame, feats: DataFrame, key: str) -> DataFrame:
    """Features of the customer on every sequence row; unknown customers get 0.

    A customer has one row of features: equal repeats count once, different ones fail.
    """
    names = tuple(c for c in feats.columns if c != key)
    joined = join_codes(seq, feats, key, key, names)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names})
