"""Logistic regression for several labels at once, on hashed counts of words.

Texts are counted once and stored as blocks of sparse rows. Every step of the fit is one pass over the blocks for all
labels: a task adds up its loss and gradient, a few tasks add those of the others, and the driver takes a step of
L-BFGS. What moves is a number for each label and word hash that occurs, of which there are 2 ** ``hash_bits`` at most,
whatever the size of the table.
"""

import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from strandline.sources.shared import stored

HASH_BITS = 18
RIDGE = 0.01
#: Steps that L-BFGS remembers.
MEMORY = 10


@dataclass(frozen=True)
class LabelModel:
    """Weights by word hash and label. A label seen with one value only has it as its constant, others have NaN."""

    weights: np.ndarray
    intercepts: np.ndarray
    constants: np.ndarray

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        rows = Counted.of(texts, int(self.weights.shape[0]).bit_length() - 1)
        scores = rows.times(self.weights) + self.intercepts
        return np.where(np.isnan(self.constants), _sigmoid(scores), self.constants)


@dataclass
class Counted:
    """Texts as sparse rows: ``columns[bounds[i] : bounds[i + 1]]`` are the hashes of the distinct words of text i."""

    bounds: np.ndarray
    columns: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, bits: int) -> "Counted":
        """Words stand between single spaces, empty ones are left out; null texts have none."""
        lists = pc.split_pattern(texts.fill_null(""), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        hashes = np.fromiter((zlib.crc32(word.encode()) & ((1 << bits) - 1) for word in words), np.int64, len(words))
        text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        index = coded.indices.to_numpy()
        real = np.array([bool(word) for word in words], bool)[index] if len(index) else np.zeros(0, bool)
        cells, counts = np.unique((text[real] << bits) + hashes[index[real]], return_counts=True)
        bounds = np.searchsorted(cells >> bits, np.arange(len(texts) + 1))
        return cls(bounds, (cells & ((1 << bits) - 1)).astype(np.int32), counts.astype(np.float64))

    def times(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights[self.columns] * self.counts[:, None], axis=0)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def add_transposed(self, rows: np.ndarray, total: np.ndarray) -> None:
        """Adds to ``total`` by column what the rows have times the counts."""
        order = np.argsort(self.columns, kind="stable")
        if not len(order):
            return
        columns = self.columns[order]
        text = np.repeat(np.arange(len(rows)), np.diff(self.bounds))[order]
        first = np.flatnonzero(np.r_[True, columns[1:] != columns[:-1]])
        total[columns[first]] += np.add.reduceat(rows[text] * self.counts[order][:, None], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _loss(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By row and label."""
    return np.maximum(scores, 0) - scores * y + np.log1p(np.exp(-np.abs(scores)))


def _pack(bits: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array(batch["y"].to_pylist(), float)
            blob = pickle.dumps((Counted.of(batch["text"], bits), y), protocol=5)
            yield pa.RecordBatch.from_arrays(
                [pa.array([blob], pa.binary()), pa.array([len(y)], pa.int64()), pa.array([y.sum(axis=0).tolist()], pa.list_(pa.float64()))],
                ["block", "n", "ones"],
            )

    return pack


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes that a task has."""
    found = np.empty(0, np.int32)
    for batch in batches:
        for blob in batch["block"]:
            found = np.union1d(found, pickle.loads(blob.as_buffer())[0].columns)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["feature"])


def _partial(model, fan: int, n_labels: int):
    """One row for each task that has blocks: its loss and gradient as bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, point = model.value
        total, loss, task = None, np.zeros(n_labels), 0
        for batch in batches:
            for blob in batch["block"]:
                rows, y = pickle.loads(blob.as_buffer())
                rows.columns = np.searchsorted(features, rows.columns)
                if total is None:
                    total, task = np.zeros_like(point), zlib.crc32(blob.as_buffer())
                scores = rows.times(point[:-1]) + point[-1]
                loss += _loss(scores, y).sum(axis=0)
                error = _sigmoid(scores) - y
                rows.add_transposed(error, total)
                total[-1] += error.sum(axis=0)
        if total is not None:
            whole = np.concatenate([loss[None], total]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([task % fan], pa.int32()), pa.array([whole], pa.binary())], ["slot", "part"])

    return add


def _add_up(table: pa.Table) -> pa.Table:
    whole = sum(np.frombuffer(part.as_buffer(), float) for part in table["part"].combine_chunks())
    return pa.table({"part": pa.array([np.asarray(whole).tobytes()], pa.binary())})


def fit(
    train: DataFrame, text: str, y: str, n_labels: int, hash_bits: int = HASH_BITS, max_iter: int = 20, ridge: float = RIDGE
) -> LabelModel:
    """Least mean loss of every label plus ``ridge`` / 2 times its squared weights; intercepts are free."""
    spark, size = train.sparkSession, 1 << hash_bits
    rows = train.select(F.col(text).alias("text"), F.slice(F.col(y), 1, n_labels).cast("array<double>").alias("y"))
    packed = rows.mapInArrow(_pack(hash_bits), "block binary, n bigint, ones array<double>")
    blocks = stored(packed, "counted-texts")
    n, *ones = blocks.agg(F.sum("n"), *[F.sum(F.get("ones", F.lit(k))) for k in range(n_labels)]).first()
    share = np.array(ones, float) / n if n else np.zeros(n_labels)
    open_ = (share > 0) & (share < 1)
    features = np.sort(blocks.select("block").mapInArrow(_features, "feature int").distinct().toArrow()["feature"].to_numpy())
    start = np.zeros((len(features) + 1, n_labels))
    start[-1, open_] = np.log(share[open_] / (1 - share[open_]))
    fan = max(1, math.isqrt(blocks.rdd.getNumPartitions()))

    def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
        point = flat.reshape(start.shape)
        shared = spark.sparkContext.broadcast((features, point))
        partial = blocks.select("block").mapInArrow(_partial(shared, fan, n_labels), "slot int, part binary")
        added = partial.groupBy("slot").applyInArrow(_add_up, "part binary").toArrow()
        shared.destroy()
        whole = sum(np.frombuffer(part.as_buffer(), float) for part in added["part"].combine_chunks()).reshape(-1, n_labels)
        gradient = whole[1:] / n
        gradient[:-1] += ridge * point[:-1]
        gradient[:, ~open_] = 0
        return float((whole[0] / n)[open_].sum() + ridge / 2 * (point[:-1] ** 2).sum()), gradient.ravel()

    point = minimise(objective, start.ravel(), max_iter).reshape(start.shape) if open_.any() else start
    weights = np.zeros((size, n_labels))
    weights[features] = point[:-1]
    return LabelModel(weights, point[-1], np.where(open_, np.nan, np.round(share)))


def minimise(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], point: np.ndarray, steps: int, least: float = 1e-7) -> np.ndarray:
    """L-BFGS with halved steps until the value falls as it should."""
    value, gradient = objective(point)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(gradient).max(initial=0) < least:
            break
        direction, weights = -gradient, []
        for move, change in reversed(moves):
            weights.append(move @ direction / (move @ change))
            direction = direction - weights[-1] * change
        if moves:
            move, change = moves[-1]
            direction = direction * (move @ change / (change @ change))
        for (move, change), weight in zip(moves, reversed(weights)):
            direction = direction + (weight - change @ direction / (move @ change)) * move
        slope = gradient @ direction
        length = 1.0 if moves else min(1.0, 1 / np.abs(gradient).sum())
        for _ in range(20):
            new_value, new_gradient = objective(point + length * direction)
            if new_value <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        move, change = length * direction, new_gradient - gradient
        if move @ change > 1e-12:
            moves = [*moves, (move, change)][-MEMORY:]
        point, value, gradient = point + move, new_value, new_gradient
    return point
