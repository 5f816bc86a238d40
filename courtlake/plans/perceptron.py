"""Fit of Spark ML's perceptron on large tables: the same network, start and method, its passes in numpy matrices.

Tasks hold their rows as blocks of single-precision matrices and multiply whole blocks; sums over blocks, steps and
weights are in double precision. Every pass is over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
PARTS_PER_CORE = 4
MEMORY = 10  # steps that the curvature is taken from, as in Spark ML
VALUES_KEPT = 20  # values among which the fit must still move, as in Spark ML
SEARCH_TRIALS = 10

Point = tuple[float, np.ndarray]


class SearchFailed(Exception):
    """No step along a direction lowers the loss enough."""


def _layers(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (inputs by outputs) and bias of each layer: views of a flat vector in Spark ML's order."""
    views, at = [], 0
    for n_in, n_out in zip(sizes, sizes[1:], strict=False):
        matrix, bias = weights[at : at + n_in * n_out], weights[at + n_in * n_out : at + (n_in + 1) * n_out]
        views.append((matrix.reshape(n_in, n_out), bias))
        at += (n_in + 1) * n_out
    return views


def add_block(x: np.ndarray, y: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], sums: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """Add the gradient of a block's summed cross entropy to ``sums``; returns the sum itself."""
    shown = [x]
    for matrix, bias in layers[:-1]:
        z = shown[-1] @ matrix
        z += bias
        np.negative(z, out=z)
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z += 1
        shown.append(np.reciprocal(z, out=z))
    z = shown[-1] @ layers[-1][0] + layers[-1][1]
    z -= z.max(axis=1, keepdims=True)
    delta = np.exp(z)
    total = delta.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = float((np.log(total[:, 0]) - z[rows, y]).sum(dtype=np.float64))
    delta /= total
    delta[rows, y] -= 1
    for n in range(len(layers) - 1, -1, -1):
        sums[n][0][...] += shown[n].T @ delta
        sums[n][1][...] += delta.sum(axis=0)
        if n:
            delta = delta @ layers[n][0].T
            delta *= shown[n]
            delta -= delta * shown[n]
    return loss


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        starts = range(0, len(y), BLOCK_ROWS)
        blocks = [[part[s : s + BLOCK_ROWS].tobytes() for s in starts] for part in (x, y)]
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.binary()) for b in blocks], ["x", "y"])


class Blocks:
    """The training rows of a perceptron as matrices, kept by the executors for many passes."""

    def __init__(self, perceptron: MultilayerPerceptronClassifier, rows: DataFrame):
        self.context, self.sizes = rows.sparkSession.sparkContext, list(perceptron.getLayers())
        shown = rows.select(vector_to_array(perceptron.getFeaturesCol(), "float32").alias("x"), F.col(perceptron.getLabelCol()).cast("int").alias("y"))
        packed = shown.mapInArrow(_packed, "x binary, y binary").rdd
        parts = PARTS_PER_CORE * self.context.defaultParallelism
        packed = packed.coalesce(parts) if packed.getNumPartitions() > parts else packed
        n = self.sizes[0]
        matrices = packed.map(lambda b: (np.frombuffer(b[0], np.float32).reshape(-1, n), np.frombuffer(b[1], np.int32)))
        self.matrices = matrices.persist(StorageLevel.MEMORY_AND_DISK)

    def drop(self) -> None:
        self.matrices.unpersist()

    def mean_loss(self, weights: np.ndarray) -> Point:
        """Mean cross entropy over the rows and its gradient. Tasks' sums combine in a tree."""
        sizes, known = self.sizes, self.context.broadcast(weights.astype(np.float32))

        def part(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, int, np.ndarray]]:
            layers, gradient, loss, rows = _layers(known.value, sizes), np.zeros(len(known.value)), 0.0, 0
            sums = _layers(gradient, sizes)
            for x, y in blocks:
                loss += add_block(x, y, layers, sums)
                rows += len(y)
            yield loss, rows, gradient

        loss, rows, gradient = self.matrices.mapPartitions(part).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
        known.destroy()
        return loss / rows, gradient / rows


def _between(left: tuple[float, float, float], right: tuple[float, float, float]) -> float:
    """Where a cubic through both ends (step, value, slope) is least, not close to either end."""
    if left[0] > right[0]:
        left, right = right, left
    (a, fa, da), (b, fb, db) = left, right
    d1 = da + db - 3 * (fa - fb) / (a - b)
    d2 = np.sqrt(max(d1 * d1 - da * db, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = b - (b - a) * np.float64(db + d2 - d1) / (db - da + 2 * d2)
    return float(np.clip(t, a + 0.1 * (b - a), a + 0.9 * (b - a))) if np.isfinite(t) else (a + b) / 2


def _step(f: Callable[[np.ndarray], Point], x: np.ndarray, here: Point, direction: np.ndarray, t: float) -> tuple[np.ndarray, Point]:
    """The point of a step that meets the strong Wolfe conditions, tried from length ``t`` on."""
    start, slope = here[0], float(here[1] @ direction)
    if not slope <= 0:
        raise SearchFailed("not a direction of descent")

    def tried(t: float) -> tuple[tuple[float, float, float], np.ndarray, Point]:
        at = x + t * direction
        point = f(at)
        return (t, point[0], float(point[1] @ direction)), at, point

    low, high = (0.0, start, slope), None
    for trial in range(SEARCH_TRIALS):
        end, at, point = tried(t)
        if not np.isfinite(end[1]):
            t /= 2
            continue
        if end[1] > start + 1e-4 * t * slope or (trial and end[1] >= low[1]):
            high = end
            break
        if abs(end[2]) <= 0.9 * abs(slope):
            return at, point
        if end[2] >= 0:
            low, high = end, low
            break
        low, t = end, t * 1.5
    for _ in range(SEARCH_TRIALS if high else 0):
        end, at, point = tried(_between(low, high))
        if not end[1] <= start + 1e-4 * end[0] * slope or end[1] >= low[1]:
            high = end
            continue
        if abs(end[2]) <= 0.9 * abs(slope):
            return at, point
        if end[2] * (high[0] - low[0]) >= 0:
            high = low
        low = end
    raise SearchFailed("no step found")


def _direction(gradient: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill by the curvature of the last steps, newest first."""
    toward, factors = gradient.copy(), []
    for step, change in history:
        factors.append(float(step @ toward) / float(step @ change))
        toward -= factors[-1] * change
    if history:
        step, change = history[0]
        toward *= float(step @ change) / float(change @ change)
    for (step, change), factor in zip(reversed(history), reversed(factors), strict=True):
        toward += (factor - float(change @ toward) / float(step @ change)) * step
    return -toward


def minimized(f: Callable[[np.ndarray], Point], x: np.ndarray, most: int, tolerance: float) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with the steps and stops of Spark ML, from ``x`` on: the weights reached and the values on the way."""
    point = f(x)
    values, history, failed = [point[0]], [], False
    while len(values) <= most:
        recent = values[-VALUES_KEPT:]
        still = len(values) > VALUES_KEPT and abs(point[0] - max(recent)) <= tolerance * abs(values[0])
        if still or np.linalg.norm(point[1]) <= tolerance * abs(point[0]):
            break
        try:
            direction = _direction(point[1], history)
            length = 1.0 if len(values) > 1 else 1.0 / float(np.linalg.norm(direction))
            at, reached = _step(f, x, point, direction, length)
        except SearchFailed:
            if failed:
                break
            history, failed = [], True
            continue
        history = [(at - x, reached[1] - point[1]), *history][:MEMORY]
        x, point, failed = at, reached, False
        values.append(point[0])
    return x, values


def with_weights(perceptron: MultilayerPerceptronClassifier, rows: DataFrame, weights: np.ndarray | None = None) -> MultilayerPerceptronClassificationModel:
    """Spark ML's model with the given weights, or with those that a fit begins with. A fit of no iterations needs one row only."""
    given = {} if weights is None else {perceptron.initialWeights: Vectors.dense(weights)}
    return perceptron.copy({perceptron.maxIter: 0, **given}).fit(rows.limit(1))


def fit(perceptron: MultilayerPerceptronClassifier, rows: DataFrame, blocks: Blocks) -> MultilayerPerceptronClassificationModel:
    """What ``perceptron.fit(rows)`` does, by passes over ``blocks`` of these rows. Initial weights count, if set."""
    start = with_weights(perceptron, rows).weights.toArray()
    return with_weights(perceptron, rows, minimized(blocks.mean_loss, start, perceptron.getMaxIter(), perceptron.getTol())[0])
