"""A multilayer perceptron whose rows lie in packed blocks.

The objective, layers and method are those of Spark's
``MultilayerPerceptronClassifier``: sigmoid layers, softmax at the end, mean
cross-entropy, L-BFGS with ten corrections and a strong Wolfe line search, the
same bounds on rounds and the same test of convergence.  Rows are packed once
into blocks of float32; a task multiplies whole blocks and sends back one loss
and one gradient, in doubles.  Tasks meet ``MEET`` at a time, so the driver
gets a few rows of the size of the weights, whatever the input.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a numpy step; of a partition, at least, where there are fewer than cores, and at most, about.
STEP_ROWS, SMALL_ROWS, PARTITION_ROWS = 1024, 20_000, 500_000
#: Partitions whose sums meet at once.
MEET = 64
#: Corrections, values the test of convergence looks back on, steps of a line search, its two bounds.
CORRECTIONS, LOOK_BACK, LINE_STEPS, DECREASE, CURVATURE = 10, 20, 20, 1e-4, 0.9


def start_weights(layers: Sequence[int], seed: int) -> np.ndarray:
    """Uniform within 2.4 over the root of a layer's inputs, as Spark draws them."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-2.4, 2.4, (a + 1) * b) / np.sqrt(a) for a, b in zip(layers, layers[1:])])


def unpacked(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, offsets) of each layer, in float32."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        w = weights[at:at + (a + 1) * b].astype(np.float32)
        out.append((w[:a * b].reshape(a, b), w[a * b:]))
        at += (a + 1) * b
    return out


def forward(x: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Outputs of each layer, the input first; the last are logarithms of shares."""
    out = [x]
    for k, (w, b) in enumerate(parts):
        z = out[-1] @ w
        z += b
        if k + 1 < len(parts):
            np.negative(z, out=z)
            with np.errstate(over="ignore"):                   # to infinity, whose reciprocal is 0
                np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
        else:
            z -= functools.reduce(np.maximum, z.T)[:, None]
            z -= np.log(functools.reduce(np.add, np.exp(z).T))[:, None]
        out.append(z)
    return out


def loss_and_gradient(x: np.ndarray, y: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of the rows and its gradient, in the order of the weights."""
    out = forward(x, parts)
    own = np.arange(len(y))
    loss = -float(out[-1][own, y].sum(dtype=np.float64))
    delta = np.exp(out[-1])
    delta[own, y] -= 1
    ones, grads = np.ones(len(y), np.float32), []
    for k in range(len(parts) - 1, -1, -1):
        grads += [ones @ delta, (out[k].T @ delta).ravel()]
        if k:
            delta = delta @ parts[k][0].T
            delta *= out[k]
            np.subtract(1, out[k], out=out[k])
            delta *= out[k]
    return loss, np.concatenate(grads[::-1])


def packed(rows: DataFrame, features: str, label: str) -> DataFrame:
    """(x, y): blocks of rows, as bytes of float32 and of int32."""
    def run(batches):
        for batch in batches:
            if len(batch):
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), pa.array([y.tobytes()])], ["x", "y"])

    return rows.where(F.col(label).isNotNull()).select(
        vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y")).mapInArrow(run, "x binary, y binary")


def summed(blocks: DataFrame, parts: int, layers: Sequence[int], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient summed over all blocks, in the order of the partitions."""
    shared = blocks.sparkSession.sparkContext.broadcast(weights)
    names, schema = ["part", "loss", "gradient"], "part int, loss double, gradient binary"

    def add(batches):
        own, loss, grad = unpacked(shared.value, layers), 0.0, np.zeros(len(shared.value))
        for batch in batches:
            for xs, ys in zip(batch.column(0), batch.column(1)):
                y = np.frombuffer(ys.as_buffer(), np.int32)
                x = np.frombuffer(xs.as_buffer(), np.float32).reshape(len(y), layers[0])
                for lo in range(0, len(y), STEP_ROWS):
                    more, g = loss_and_gradient(x[lo:lo + STEP_ROWS], y[lo:lo + STEP_ROWS], own)
                    loss += more
                    grad += g
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([loss]),
                                          pa.array([grad.tobytes()])], names)

    def meet(key, t):
        t = t.sort_by("part")
        grad = sum(np.frombuffer(g.as_buffer()) for c in t["gradient"].chunks for g in c)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "loss": [sum(t["loss"].to_pylist())],
                         "gradient": [grad.tobytes()]})

    sums = blocks.mapInArrow(add, schema)
    if parts > MEET:
        sums = sums.groupBy(F.floor(F.col("part") / MEET).cast("int").alias("at")).applyInArrow(meet, schema)
    found = sorted(sums.collect(), key=lambda r: r["part"])
    shared.destroy()
    return sum(r["loss"] for r in found), sum((np.frombuffer(bytes(r["gradient"])) for r in found), np.zeros(len(weights)))


def line_search(f: Callable, x: np.ndarray, p: np.ndarray, f0: float, d0: float, step: float):
    """(point, value, gradient) that meet the strong Wolfe conditions along ``p``,
    or the lowest point met; None if none is lower."""
    low, high, best = (0.0, f0, d0), None, None
    for _ in range(LINE_STEPS):
        value, grad = f(x + step * p)
        slope = float(grad @ p)
        if not np.isfinite(value) or value > f0 + DECREASE * step * d0 or value >= low[1]:
            high = (step, value, slope)
        else:
            best = (x + step * p, value, grad)
            if abs(slope) <= -CURVATURE * d0:
                return best
            if slope >= 0 if high is None else slope * (high[0] - low[0]) >= 0:
                high = low
            low = (step, value, slope)
        if high is None:
            step *= 2
            continue
        width = high[0] - low[0]
        bend = high[1] - low[1] - low[2] * width                # a parabola through both values and the lower's slope
        share = -low[2] * width / (2 * bend) if np.isfinite(bend) and bend > 0 else 0.5
        step = low[0] + min(max(share, 0.1), 0.9) * width
    return best


def lbfgs(f: Callable, x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Minimum of ``f`` (value, gradient).  Ends after ``max_iter`` steps, when no
    value of the last ``LOOK_BACK`` is above the present one by ``tol`` of the
    first, or when the gradient is within ``tol`` of the value."""
    value, grad = f(x)
    first, memory, past = value, deque(maxlen=CORRECTIONS), deque([value], maxlen=LOOK_BACK)
    for _ in range(max_iter):
        if np.linalg.norm(grad) <= max(tol * value, 1e-8):
            break
        for again in range(2):
            p, kept = -grad, []
            for s, y in reversed(memory):
                a = s @ p / (s @ y)
                kept.append(a)
                p = p - a * y
            if memory:
                s, y = memory[-1]
                p = p * (s @ y / (y @ y))
            for (s, y), a in zip(memory, reversed(kept)):
                p = p + s * (a - y @ p / (s @ y))
            slope = float(grad @ p)
            step = 1.0 if memory else 1 / np.linalg.norm(grad)
            found = line_search(f, x, p, value, slope, step) if slope < 0 else None
            if found or not memory:
                break
            memory.clear()                                     # once more, down the gradient
        if not found:
            break
        s, y = found[0] - x, found[2] - grad
        if s @ y > 0:
            memory.append((s, y))
        x, value, grad = found
        past.append(value)
        if max(past) - value <= tol * abs(first):
            break
    return x


@dataclass
class Model:
    layers: list[int]
    weights: np.ndarray
    features: str = "features"

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``probability``, a vector of the classes' shares."""
        shared = rows.sparkSession.sparkContext.broadcast(self.weights)
        layers = self.layers

        @F.pandas_udf("array<double>")
        def shares(x):
            import pandas as pd
            own = unpacked(shared.value, layers)
            wide = np.stack(x.to_numpy()).astype(np.float32) if len(x) else np.zeros((0, layers[0]), np.float32)
            done = [np.exp(forward(wide[lo:lo + STEP_ROWS], own)[-1].astype(float)) for lo in range(0, len(wide), STEP_ROWS)]
            return pd.Series(list(np.concatenate(done)) if done else [], dtype=object)

        return rows.withColumn("probability", array_to_vector(shares(vector_to_array(self.features))))


@dataclass
class Perceptron:
    layers: list[int]
    features: str = "features"
    label: str = "label"
    max_iter: int = 100
    tol: float = 1e-6
    seed: int = 2019

    def fit(self, train: DataFrame) -> Model:
        blocks = packed(train, self.features, self.label)
        rows = train.where(F.col(self.label).isNotNull()).count()
        cores = train.sparkSession.sparkContext.defaultParallelism
        parts = max(1, min(cores, rows // SMALL_ROWS), -(-rows // PARTITION_ROWS))
        if parts > cores:
            parts = -(-parts // cores) * cores
        blocks = blocks.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
        weights = start_weights(self.layers, self.seed)

        def mean(at):
            loss, grad = summed(blocks, parts, self.layers, at)
            return loss / rows, grad / rows

        try:
            return Model(self.layers, lbfgs(mean, weights, self.max_iter, self.tol) if rows else weights, self.features)
        finally:
            blocks.unpersist()
