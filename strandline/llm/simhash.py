"""SimHash near-duplicates: fingerprints of 3-word shingles, linked by multi-index hashing.

Two fingerprints with at most three different bits differ in at most one bit of one of their 32-bit halves. Each half
of every distinct fingerprint is a row of an index; a fingerprint looks up the small Hamming ball around its own
halves (itself and one bit flipped from 0 to 1, so that a pair is met from one side only), and what it finds is
verified over all 64 bits.

Null texts count as empty; a text without words has the fingerprint zero, which is linked like any other. Rows that
repeat a ``doc_id`` give a row each, null ids too. A null cannot name a component: it links like any other row, and its
component is null only if nothing that it reaches has an id. Other columns of the input are not read. An empty table
gives an empty result.
"""

import itertools
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.llm.common import components, with_group_totals
from strandline.sources.shared import stored

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints with one half in common that are still compared pair by pair.
CROWD = 1_000
#: Hashes whose bits are counted at once.
_BLOCK = 1 << 16
#: Holds a long and numbers behind all longs.
_WIDE = "decimal(20,0)"
_BEHIND_IDS = Decimal(1 << 63)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64 bits; a bit is 1 if it is set in over half of the hashes of the shingles, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    n = max(1, len(words) - width + 1)
    first = (ends - lengths)[:n].tolist()
    last = (ends - 1)[len(words) - n :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for start in range(0, n, _BLOCK):
        spans = zip(first[start : start + _BLOCK], last[start : start + _BLOCK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(text.as_py()) for text in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints, pa.int64())], ["doc_id", "print"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long."""
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id bigint, print bigint")


def print_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): fingerprints of (print) within ``MAX_BITS`` bits of each other.

    These are all such pairs but for halves that more than ``crowd`` fingerprints share, as those of many copies of a
    text do: there, fewer links connect the same fingerprints.
    """
    halves = F.explode(
        F.array(
            F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("print", 32).alias("value")),
            F.struct(F.lit(1).alias("half"), F.col("print").bitwiseAND(F.lit(0xFFFFFFFF)).alias("value")),
        )
    )
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = prints.repartition(partitions, "print")  # a given number: a few bytes become some thirty rows each
    index = spread.select("print", halves.alias("key")).select("print", "key.*")
    ball = index.withColumnRenamed("print", "a").withColumn("flip", F.explode(_masks(1)))
    ball = ball.filter(F.col("value").bitwiseAND(F.col("flip")) == 0).withColumn("value", F.col("value").bitwiseXOR(F.col("flip")))
    index = index.withColumnRenamed("print", "b")
    crowded = stored(
        index.groupBy("half", "value").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("half", "value"),
        "crowded-halves",
    )
    if crowded.isEmpty():
        return _verified(ball, index)
    keys = ["half", "value"]
    thin = _verified(ball, index.join(crowded, keys, "left_anti"))
    return thin.unionByName(_crowded_links(ball.join(crowded, keys), index.join(crowded, keys)))


def _verified(ball: DataFrame, index: DataFrame) -> DataFrame:
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    found = ball.join(index, ["half", "value"])
    return found.filter(near & ((F.col("flip") != 0) | (F.col("a") < F.col("b")))).select("a", "b")


def _masks(radius: int) -> Column:
    """All words of 32 bits with at most ``radius`` ones, as one literal."""
    ones = [sum(1 << bit for bit in bits) for k in range(radius + 1) for bits in itertools.combinations(range(32), k)]
    return F.split(F.lit(",".join(map(str, ones))), ",").cast("array<bigint>")


def _crowded_links(ball: DataFrame, index: DataFrame) -> DataFrame:
    """Links between fingerprints that meet in a crowded half, in proportion to their number.

    What is left of the three bits, r, is in the other half. Two halves within r bits have a word between them, one
    bit from b and r - 1 bits from a; and all that have a word in common are linked. So each a is linked to the least b
    of its words, and each b to the least a. At most some thousand fingerprints are so near to one word.
    """
    other = lambda c: F.when(F.col("half") == 0, F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(c, 32))
    near_a = F.explode(F.when(F.col("flip") == 0, _masks(MAX_BITS - 1)).otherwise(_masks(MAX_BITS - 2)))
    left = ball.withColumn("mask", near_a).select("half", "value", other("a").bitwiseXOR(F.col("mask")).alias("word"), "a", F.lit(None).cast("long").alias("b"))
    right = index.withColumn("mask", F.explode(_masks(1))).select("half", "value", other("b").bitwiseXOR(F.col("mask")).alias("word"), F.lit(None).cast("long").alias("a"), "b")
    together = Window.partitionBy("half", "value", "word")
    met = left.unionByName(right).select("a", "b", F.min("a").over(together).alias("least_a"), F.min("b").over(together).alias("least_b"))
    ends = met.select(F.coalesce("a", "least_a").alias("a"), F.coalesce("b", "least_b").alias("b"))
    return ends.filter("a != b").distinct()


def near_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): hexadecimal fingerprints, and the smallest ``doc_id`` that links reach."""
    rows = stored(fingerprints(documents), "fingerprints")
    totals = {"first": (F.min("doc_id"), F.min)}
    same = stored(with_group_totals(rows, ["print"], ["doc_id"], totals).withColumn("class", _class()), "same-fingerprint")
    classes = same.groupBy("print").agg(F.min("class").alias("class"))
    links = print_links(classes.select("print"))
    named = classes.withColumnRenamed("print", "a").withColumnRenamed("class", "class_a")
    other = classes.withColumnRenamed("print", "b").withColumnRenamed("class", "class_b")
    between = links.join(named, "a").join(other, "b").select("class_a", "class_b")
    groups = components(between, "class_a", "class_b")
    linked = same.join(groups, same["class"] == groups["node"], "left")
    component = F.coalesce("component", "class")
    return linked.select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(component < _BEHIND_IDS, component.cast("long")).alias("component_id"),
    )


def _class() -> Column:
    """A number for each fingerprint: its smallest ``doc_id``, or, behind all of these, one of its own without an id."""
    unnamed = F.col("print").cast(_WIDE) + (2 * _BEHIND_IDS)
    return F.coalesce(F.col("first").cast(_WIDE), unnamed.cast(_WIDE)).alias("class")


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """The documents but those with a smaller ``doc_id`` in their component, with all columns; null ids stay."""
    dropped = near_groups(documents).filter("doc_id != component_id").select(F.col("doc_id").alias("__dropped"))
    return documents.join(dropped, F.col("doc_id") == F.col("__dropped"), "left_anti")
