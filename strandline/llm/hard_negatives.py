"""Hard negatives by Fagin's threshold algorithm over whole-number vectors.

Vectors are cut into shards by row, of bounded size whatever their labels. A shard sorts its vectors once for every
dimension. An anchor goes down these lists in step, from the top where its own component is positive and from the
bottom where it is negative; every vector that turns up is scored by its whole inner product. What the last entries
seen would add up to is the threshold: no vector still unseen scores more. An anchor stops when the threshold falls
strictly below the k-th score of each of its windows, so that not even a tie is missed, or below a window's floor.
Every shard gives the first k of every window, and the first k of all these are the result, exactly.

An anchor asks twice: for the first rows of its own label, its positives, with one window without bounds; then for
rows of other labels, with a window for every score of a positive. Anchors are asked in blocks, and each block meets
each shard in one task: nothing is broadcast, nothing passes the driver, and no task's size depends on the data.

A row takes no part if its label, its vector or a component is null, or a component is not finite. Vectors may differ
in width; a missing component is zero. Repeated rows are rows of their own, as positives, negatives and anchors. Rows
without a ``vec_id`` are candidates, behind all others of their score. Other columns are not read. An empty table gives
an empty result. Products beyond 2 ** 53 are computed with Python's integers; scores beyond 64 bits are an error.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.sources.shared import stored

POSITIVES, NEGATIVES = 5, 10
#: Negatives have 30 to 90 of 100 parts of the positive's score.
LOW, HIGH, WHOLE = 30, 90, 100
SCALE = 256
SHARD_ROWS, BLOCK_ROWS = 65_536, 4_096
#: Vectors of a shard at least, unless there are fewer; below, sorting lists costs more than it saves.
LEAST_ROWS = 1_024
#: Entries of each list that are read before the threshold is first looked at; doubled each time.
FIRST_DEPTH = 32
_EXACT = float(1 << 53)
_PARTIAL = "anchor bigint, anchor_id bigint, mark bigint, other bigint, other_id bigint, score bigint"


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector): usable rows; the label of every seventh id is shifted, components are whole numbers."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").cast("long"), shifted.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & usable)


@dataclass
class SortedLists:
    """Vectors of one width, and for every dimension their order from the largest component down."""

    ids: np.ndarray  # with the largest number in place of null
    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    order: np.ndarray  # by dimension
    values: np.ndarray
    largest: np.ndarray  # absolute component by dimension

    @classmethod
    def of(cls, ids, rows, labels, vectors: np.ndarray) -> "SortedLists":
        order = np.argsort(-vectors, axis=0, kind="stable").T
        values = np.take_along_axis(vectors.T, order, axis=1)
        return cls(ids, rows, labels, vectors, order.astype(np.int32), values, np.abs(vectors).max(axis=0, initial=0))

    def scores(self, found: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products of some vectors, exactly."""
        if (self.largest * np.abs(anchor)).sum() < _EXACT:
            return (self.vectors[found] @ anchor).astype(np.int64)
        whole = [int(x) for x in anchor]
        return np.array([sum(int(x) * y for x, y in zip(v, whole)) for v in self.vectors[found]], np.int64)

    def threshold(self, anchor: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int):
        """No vector behind the first ``depth`` of every list scores more."""
        last, first = self.values[up, depth - 1], self.values[down, len(self.ids) - depth]
        if (self.largest * np.abs(anchor)).sum() < _EXACT:
            return float(last @ anchor[up] + first @ anchor[down])
        pairs = [*zip(last, anchor[up]), *zip(first, anchor[down])]
        return sum(int(x) * int(y) for x, y in pairs)


@dataclass(frozen=True)
class Span:
    """Scores from ``low`` to ``high``, of which the first ``k`` are wanted; None is no bound."""

    low: int | None
    high: int | None
    k: int

    def inside(self, scores: np.ndarray) -> np.ndarray:
        found = np.ones(len(scores), bool)
        if self.low is not None:
            found &= (scores >= self.low).astype(bool)
        if self.high is not None:
            found &= (scores <= self.high).astype(bool)
        return found


def window(positive: int) -> Span:
    """The scores s with LOW * positive <= WHOLE * s <= HIGH * positive; none if the positive's is negative."""
    return Span(-(-LOW * positive // WHOLE), HIGH * positive // WHOLE, NEGATIVES)


def first_rows(
    lists: SortedLists, anchor: np.ndarray, allowed: np.ndarray, spans: list[Span], first_depth: int = FIRST_DEPTH
) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """(places, scores) of the first rows of each span among the allowed ones, and how deep the lists were read."""
    size, width = len(lists.ids), min(len(anchor), lists.vectors.shape[1])
    own = np.zeros(lists.vectors.shape[1])
    own[:width] = anchor[:width]
    up, down = np.flatnonzero(own > 0), np.flatnonzero(own < 0)
    seen, depth, step = np.zeros(size, bool), 0, first_depth
    places: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    while depth < size:
        end = min(size, depth + step) if len(up) + len(down) else size
        new = np.zeros(size, bool)
        if len(up) + len(down):
            new[lists.order[up, depth:end].ravel()] = True
            new[lists.order[down, size - end : size - depth].ravel()] = True
        else:  # all vectors score zero
            new[:] = True
        found = np.flatnonzero(new & ~seen)
        seen[found] = True
        found = found[allowed[found]]
        places.append(found)
        scores.append(lists.scores(found, own))
        depth, step = end, 2 * step
        if depth < size and _settled(lists.threshold(own, up, down, depth), np.concatenate(scores), spans):
            break
    place, score = np.concatenate(places or [np.empty(0, np.int64)]), np.concatenate(scores or [np.empty(0, np.int64)])
    result = []
    for span in spans:
        at = np.flatnonzero(span.inside(score))
        at = at[np.lexsort((lists.rows[place[at]], lists.ids[place[at]], -score[at]))][: span.k]
        result.append((place[at], score[at]))
    return result, depth


def _settled(threshold, scores: np.ndarray, spans: list[Span]) -> bool:
    """Whether nothing unseen can be among the first of any span."""
    for span in spans:
        if span.low is not None and (threshold < span.low or span.high < span.low):
            continue
        inside = scores[span.inside(scores)]
        if len(inside) < span.k or not threshold < np.sort(inside)[-span.k]:
            return False
    return True


_NO_ID = np.iinfo(np.int64).max


def _vectors(table: pa.Table, name: str = "vector") -> list[np.ndarray]:
    return [np.asarray(v, float) for v in table[name].to_numpy(zero_copy_only=False)]


def _shard_lists(table: pa.Table) -> list[SortedLists]:
    """The lists of a shard, one set for each width."""
    ids = table["vec_id"].fill_null(_NO_ID).to_numpy()
    rows, labels, vectors = table["row"].to_numpy(), table["label"].to_numpy(), _vectors(table)
    widths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    result = []
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        matrix = np.floor(SCALE * np.stack([vectors[i] for i in at]))
        result.append(SortedLists.of(ids[at], rows[at], labels[at], matrix))
    return result


def _ask(same_label: bool):
    """Every anchor of a block asks a shard: for rows of its own label, or of others in the windows of its positives."""

    def ask(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        sets = _shard_lists(shard) if len(block) else []
        marks = block["marks"].to_pylist()
        for number, (anchor, anchor_id, label, vector) in enumerate(
            zip(block["anchor"].to_pylist(), block["anchor_id"].to_pylist(), block["own"].to_pylist(), _vectors(block, "query"))
        ):
            wanted = [0] if same_label else sorted(set(marks[number]))
            spans = [Span(None, None, POSITIVES)] if same_label else [window(score) for score in wanted]
            for lists in sets:
                allowed = lists.labels == label if same_label else lists.labels != label
                if same_label:
                    allowed &= lists.rows != anchor
                for mark, (place, score) in zip(wanted, first_rows(lists, np.floor(SCALE * vector), allowed, spans)[0]):
                    n = len(place)
                    columns = [anchor], [anchor_id], [mark]
                    out.append((*[np.repeat(c, n) for c in columns], lists.rows[place], lists.ids[place], score))
        columns = [np.concatenate(c) for c in zip(*out)] or [np.empty(0, np.int64)] * 6
        arrays = [pa.array(c.astype(np.int64)) for c in columns]
        arrays[4] = pa.array(columns[4].astype(np.int64), mask=columns[4] == _NO_ID)
        return pa.table(arrays, names=[c.split()[0] for c in _PARTIAL.split(", ")])

    return ask


def _asked(shards: DataFrame, anchors: DataFrame, blocks: int, same_label: bool, k: int) -> DataFrame:
    """The first ``k`` answers of all shards to each anchor, with their ``rank``."""
    shard_rows = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pieces = anchors.withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).drop("shards")
    answers = shard_rows.groupBy("shard", "block").cogroup(pieces.groupBy("shard", "block")).applyInArrow(_ask(same_label), _PARTIAL)
    by_score = Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), F.col("other_id").asc_nulls_last(), "other")
    return answers.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1 among those returned."""
    spark = embeddings.sparkSession
    rows = stored(prepared(embeddings).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % 100 == 0)).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // max(LEAST_ROWS, min(shard_rows, -(-n // partitions)))))
    blocks = max(1, -(-asked // block_rows))
    dealt = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(parts))
    in_shards = rows.withColumn("shard", dealt("shard", shards).cast("int"))
    named = [F.col(c).alias(name) for c, name in (("row", "anchor"), ("vec_id", "anchor_id"), ("label", "own"), ("vector", "query"))]
    anchors = rows.filter(F.col("vec_id") % 100 == 0)
    anchors = anchors.select(*named, dealt("block", blocks).alias("block"), F.lit(shards).cast("int").alias("shards"))
    first = anchors.withColumn("marks", F.array().cast("array<bigint>"))
    positives = stored(_asked(in_shards, first, blocks, True, POSITIVES), "positives")
    marks = positives.groupBy("anchor").agg(F.collect_list("score").alias("marks"))  # POSITIVES at most
    negatives = _asked(in_shards, anchors.join(marks, "anchor"), blocks, False, NEGATIVES)
    pairs = positives.select("anchor", F.col("score").alias("mark"), F.col("other_id").alias("positive_id"))
    return negatives.join(pairs, ["anchor", "mark"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int"),
        F.col("other_id").alias("negative_id"),
        F.col("mark").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
