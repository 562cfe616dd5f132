"""Samples and splits that come out the same on every run and every cluster."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from strandline.constants import SAMPLE_SHARE, SEED, TEST_SHARE, VALID_SHARE
from strandline.functions.hashing import draw, hit, whole_hash
from strandline.sources.shared import stored

#: Hex digits by which a selection is refined at once: 4,096 counts reach the driver.
DIGITS = 3
#: Hashes that are sorted on the driver once so few are left.
FEW = 4_096


def stratified_sample(
    df: DataFrame, col: str, fractions: dict | None, key: str, seed: int = SEED
) -> DataFrame:
    """Keep about the given share of the rows of each listed class, and no others.

    Without ``fractions`` a tenth of the classes 0 and 1.
    """
    if fractions is None:
        fractions = {0: SAMPLE_SHARE, 1: SAMPLE_SHARE}
    share: Column = F.lit(0.0)
    for value, fraction in fractions.items():
        share = F.when(F.col(col) == value, F.lit(float(fraction))).otherwise(share)
    return df.filter(draw(seed, F.col(key)) < share)


def split(
    df: DataFrame, key: str, test: float = TEST_SHARE, valid: float = VALID_SHARE, seed: int = SEED, name: str = "split"
) -> DataFrame:
    """Column with 'test', or 'valid' / 'train' for the rest. Rows with the same key stay together.

    One look at each row; sizes are close to the shares. ``split_exact`` has them to the row.
    """
    part = F.when(hit(test, seed, "test", F.col(key)), "test").when(hit(valid, seed, "valid", F.col(key)), "valid")
    part = part.otherwise("train")
    return df.withColumn(name, part)


def split_exact(
    df: DataFrame, key: str, test: float = TEST_SHARE, valid: float = VALID_SHARE, seed: int = SEED, name: str = "split"
) -> DataFrame:
    """``split`` with exact sizes: of n keys ceil(test * n) are 'test', of the m others ceil(valid * m) 'valid'.

    The keys with the smallest hashes are taken, and the last of them is found by counting hashes by their first
    digits, then those that begin like it by the next ones: nothing is sorted, and rows are only compared with it.
    Needs one narrow shuffle of the keys; null is a key.
    """
    hashes = df.select(F.col(key).alias("__key")).distinct()
    hashes = stored(hashes.select(*[whole_hash(seed, kind, F.col("__key")).alias(kind) for kind in ("test", "valid")]), "hashes")
    n = hashes.count()
    last_test = kth_smallest(hashes, "test", math.ceil(test * n))
    others = hashes.filter(F.col("test") > last_test)
    last_valid = kth_smallest(others, "valid", math.ceil(valid * (n - math.ceil(test * n))))
    part = F.when(whole_hash(seed, "test", F.col(key)) <= last_test, "test").when(
        whole_hash(seed, "valid", F.col(key)) <= last_valid, "valid"
    )
    return df.withColumn(name, part.otherwise("train"))


def kth_smallest(hashes: DataFrame, column: str, k: int) -> str:
    """The k-th smallest of the hexadecimal hashes in a stored column, "" for k = 0."""
    if k <= 0:
        return ""
    prefix, left, inside = "", k, None
    while inside is None or inside > FEW:
        here = hashes.filter(F.col(column).startswith(prefix)) if prefix else hashes
        counts = here.groupBy(F.substring(column, len(prefix) + 1, DIGITS).alias("digits")).agg(F.count("*").alias("n"))
        for digits, inside in sorted(map(tuple, counts.collect())):
            if left <= inside:
                prefix += digits
                break
            left -= inside
        if not digits:  # all digits are used: equal hashes
            return prefix
    return sorted(row[0] for row in hashes.filter(F.col(column).startswith(prefix)).select(column).collect())[left - 1]
