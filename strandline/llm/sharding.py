"""Shards of documents, and numpy arrays that travel between shards and buckets.

A shard is a group of documents by a hash, a few megabytes of text. What a shard knows about keys of 64 bits is sent
as sorted arrays: the range of keys is cut into buckets, so each bucket gets one slice of the array per shard that has
keys there. A bucket answers each slice with an array of the same length, and a shard puts its answers together in the
order of the buckets. Slices never outnumber keys.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SHARD_BYTES = 8 << 20


def text_bytes(documents: DataFrame) -> int:
    return documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shard_count(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """At least one shard per shuffle partition, so that small inputs use all cores too."""
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1 + text_bytes(documents) // shard_bytes, partitions)


def sharded(documents: DataFrame, shards: int) -> DataFrame:
    """(shard, doc_id, text), partitioned by shard. Its one shuffle is reused wherever a plan has it again."""
    rows = documents.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
    )
    return rows.repartition(shards, "shard")


def bucket_bounds(buckets: int) -> np.ndarray:
    """The first key of every bucket but the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the stretches of sorted keys that fall into a bucket."""
    cuts = np.concatenate([[0], np.searchsorted(keys, bucket_bounds(buckets)), [len(keys)]])
    for bucket in np.flatnonzero(np.diff(cuts)):
        yield int(bucket), int(cuts[bucket]), int(cuts[bucket + 1])


def column_arrays(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    """The arrays of a binary column."""
    return [np.frombuffer(value.as_buffer(), kind) for chunk in table[name].chunks for value in chunk]


#: Counts of a shard's keys of kind ``n`` in one bucket, and the sums that a bucket answers with.
COUNTS = pa.schema([
    ("shard", pa.int32()), ("n", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())
])
COUNTS_DDL = "shard int, n int, bucket int, keys binary, counts binary"
_TOTALS = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())])


def sum_counts(counts: DataFrame) -> DataFrame:
    """(shard, n, bucket, totals): for every key of every slice the sum of its counts over all shards, as int64."""
    return counts.groupBy("n", "bucket").applyInArrow(_add_up, "shard int, n int, bucket int, totals binary")


def _add_up(table: pa.Table) -> pa.Table:
    keys = column_arrays(table, "keys", np.uint64)
    counts = np.concatenate(column_arrays(table, "counts", np.uint32)).astype(np.int64)
    distinct, entry = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(entry, counts, len(distinct)).astype(np.int64)[entry]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    answers = pa.array([part.tobytes() for part in np.split(totals, cuts)], pa.binary())
    return pa.table([table["shard"], table["n"], table["bucket"], answers], schema=_TOTALS)
