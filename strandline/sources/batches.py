"""Fixed-size batches."""

from pyspark.sql import DataFrame, Window, functions as F

from strandline.constants import SEED
from strandline.functions.hashing import hash32
from strandline.operators.ordering import with_position


#: A million buckets: their counts are broadcast.
MAX_BITS = 20


def make_batches(
    df: DataFrame,
    key: str,
    batch_size: int,
    seed: int = SEED,
    shuffle: bool = True,
    drop_remainder: bool = False,
    bucket_bits: int | None = None,
) -> DataFrame:
    """Add ``position`` and ``batch_id``; ``key`` has to be unique per row.

    Shuffled rows come in the order of a seeded hash. The hash is uniform, so its top bits
    cut the rows into equal buckets, each numbered by its own task, and one count per
    bucket is enough to join the numbers up. There are 2 ** ``bucket_bits`` buckets, by default
    four for each shuffle partition and 4,096 at least.
    """
    if bucket_bits is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        bucket_bits = min(MAX_BITS, max(12, (4 * partitions - 1).bit_length()))
    if shuffle:
        rows = df.withColumn("__hash", hash32(seed, F.col(key)))
        rows = rows.withColumn("__bucket", F.shiftright("__hash", 32 - bucket_bits))
        before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = (
            rows.groupBy("__bucket")
            .agg(F.count("*").alias("__n"))
            .select(
                "__bucket",
                F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
                F.sum("__n").over(Window.partitionBy()).alias("__total"),
            )
        )
        inside = Window.partitionBy("__bucket").orderBy("__hash", key)
        placed = (
            rows.withColumn("__row", F.row_number().over(inside) - 1)
            .join(F.broadcast(starts), "__bucket")  # at most 2 ** bucket_bits rows
            .withColumn("position", F.col("__start") + F.col("__row"))
            .drop("__hash", "__bucket", "__row", "__start")
        )
    else:
        placed = with_position(df, key)
        if drop_remainder:
            placed = placed.withColumn("__total", F.lit(placed.count()))  # rows are stored by now
    batches = placed.withColumn("batch_id", F.floor(F.col("position") / F.lit(batch_size)))
    if drop_remainder:
        batches = batches.filter(F.col("batch_id") < F.floor(F.col("__total") / F.lit(batch_size)))
    return batches.drop("__total")


def write_batches(batches: DataFrame, path: str, batches_per_group: int = 1000, mode: str = "error") -> None:
    """One folder per group of consecutive batches, rows in order inside a file."""
    grouped = batches.withColumn("batch_group", F.floor(F.col("batch_id") / F.lit(batches_per_group)))
    grouped.repartition("batch_group").sortWithinPartitions("batch_group", "position").write.mode(mode).partitionBy(
        "batch_group"
    ).parquet(path)
