"""Exact positions and running totals without a single-task window.

A global ``row_number`` sends every row to one task. Here the rows are range
partitioned, so equal-sized slices land in different tasks however skewed the
leading columns are, and only one count per partition is summed up across them.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.sources.shared import reliable_checkpoint

_PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit
_SLOT = "__slot"
_BLOCK = "__block"

BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a narrow table proven to have at most ``max_rows`` rows.

    A bigger one goes without the hint, into a shuffled join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def order_output(df: DataFrame, *cols) -> DataFrame:
    """Total order, for final results that ask for one."""
    return df.orderBy(*cols)


def preview(df: DataFrame, *keys, n: int = 10) -> DataFrame:
    """First n rows in key order, so that two looks show the same rows."""
    return df.orderBy(*keys).limit(n)


def union_all(*dfs: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name, duplicates kept."""
    first, *rest = dfs
    for df in rest:
        first = first.unionByName(df)
    return first


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """0-based position of every row in the total order of ``order``.

    ``order`` has to be unique per row. Range boundaries come from a sample, so the
    partitioned rows are checkpointed once: counts and rows then see the same cut.
    """
    rows = _range_slots(df, *order)
    counts = rows.groupBy(_BLOCK).agg(F.count("*").alias("__n"))
    starts = _exclusive_totals(counts, {"__start": "__n"})
    within = F.col(_SLOT).bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    return (
        rows.join(F.broadcast(starts), _BLOCK)
        .withColumn(name, F.col("__start") + within)
        .drop(_BLOCK, _SLOT, "__start")
    )


def with_running_totals(df: DataFrame, order: Column, sums: dict[str, str]) -> DataFrame:
    """Inclusive running totals over a total order: ``{result: summed column}``."""
    rows = _range_slots(df, order)
    totals = rows.groupBy(_BLOCK).agg(*[F.sum(c).alias(c) for c in set(sums.values())])
    starts = _exclusive_totals(totals, {f"__from_{out}": c for out, c in sums.items()})
    inside = Window.partitionBy(_BLOCK).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(inside).alias(f"__in_{out}") for out, c in sums.items()])
    joined = local.join(F.broadcast(starts), _BLOCK)
    for out in sums:
        joined = joined.withColumn(out, F.col(f"__from_{out}") + F.col(f"__in_{out}"))
        joined = joined.drop(f"__from_{out}", f"__in_{out}")
    return joined.drop(_BLOCK, _SLOT)


def _range_slots(df: DataFrame, *order) -> DataFrame:
    """Range partitioned and sorted rows, with their slot number and partition."""
    sliced = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = reliable_checkpoint(sliced.withColumn(_SLOT, F.monotonically_increasing_id()))
    return rows.withColumn(_BLOCK, F.shiftright(_SLOT, _PARTITION_SHIFT))


def _exclusive_totals(per_block: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Totals of all earlier blocks. One row per range partition: small by construction."""
    before = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        _BLOCK, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(out) for out, c in sums.items()]
    )


def heavy_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows: one narrow pass, combined before its shuffle."""
    counts = df.groupBy(F.col(key).alias("__heavy")).agg(F.count("*").alias("__n"))
    return reliable_checkpoint(counts.filter(F.col("__n") > limit).select("__heavy"))


def split_heavy(df: DataFrame, key: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of all other keys, which are bounded per key, and rows of the heavy ones.

    The second part is None when there are none. It needs a plan that never puts one key
    into one task.
    """
    if heavy.isEmpty():
        return df, None
    heavy = broadcast_if_small(heavy)
    match = F.col(key).eqNullSafe(F.col("__heavy"))
    return df.join(heavy, match, "left_anti"), df.join(heavy, match, "left_semi")
