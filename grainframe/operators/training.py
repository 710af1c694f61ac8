"""Softmax regression whose gradients Spark sums, and the temperature that calibrates it.

A step is one map over the training rows, each task giving the sum of its rows' gradients, and a grouped sum of those; what
reaches the driver is one gradient, as large as the model. The driver takes the step (Adam, from zero) and sends the weights
out again. Rows are standardised and written once. All temperatures of a grid are tried in one pass over the calibration rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainframe.sources.workspace import Workspace

BETAS, EPSILON = (0.9, 0.999), 1e-8


@dataclass
class SoftmaxModel:
    """Classes in order, the standardisation, weights (a row a class) and biases, the temperature and its mean loss."""

    classes: list
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    loss: float | None = None

    def frame(self, spark: SparkSession, class_type: str = "string") -> DataFrame:
        """``class, weights, bias``, as ``vectors.predict_linear`` takes them."""
        rows = [(c, w.tolist(), float(b)) for c, w, b in zip(self.classes, self.weights, self.bias)]
        return spark.createDataFrame(rows, f"class {class_type}, weights array<double>, bias double")


def usable(rows: DataFrame, vector: str, target: str, classes: list) -> DataFrame:
    """``x, y``: vectors of finite values and the place of their class. Rows of no listed class, or without a vector, are left out."""
    finite = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    place = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(target)) - 1
    return rows.where(finite & (F.size(vector) > 0)).select(F.transform(vector, lambda v: v.cast("double")).alias("x"), place.cast("int").alias("y")).where("y >= 0")


def standardisation(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of each dimension of ``x``; 1 for a constant one."""
    moments = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    found = sorted(map(tuple, moments.collect()))
    mean, scale = np.array([m for _, m, _ in found]), np.array([s for *_, s in found])
    return mean, np.where(scale == 0, 1.0, scale)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _logs(logits: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities."""
    logits = logits - logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def gradient(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Mean gradient of the cross entropy over standardised rows (``x, y``): a row a class, its bias last."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, bias))
    width = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        total, n = np.zeros((len(b), width + 1)), 0
        for batch in batches:
            x, y = _matrix(batch.column(0), width), batch.column(1).to_numpy()
            wrong = np.exp(_logs(x @ w.T + b))
            wrong[np.arange(len(y)), y] -= 1
            total[:, :width] += wrong.T @ x
            total[:, width] += wrong.sum(axis=0)
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), float(n)))], names=["at", "v"])

    sums = dict(map(tuple, rows.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v")).collect()))
    shared.destroy()
    size = len(bias) * (width + 1)
    return np.array([sums[i] for i in range(size)]).reshape(len(bias), width + 1) / sums[size]


def train_softmax(rows: DataFrame, vector: str, target: str, classes: list, iterations: int = 200, rate: float = 0.03, l2: float = 0.01) -> SoftmaxModel:
    """A model of mean cross entropy and ``l2 / 2`` times the squared weights, after ``iterations`` steps of Adam from zero.

    Every class needs rows; vectors are of one length. ``ValueError`` otherwise, and where the loss is no longer finite.
    """
    work = Workspace(rows.sparkSession, "training")
    held = work.save(usable(rows, vector, target, classes), "usable")
    present = {r[0] for r in held.select("y").distinct().collect()}
    if len(present) != len(classes):
        raise ValueError("every class needs training rows")
    mean, scale = standardisation(held)
    fixed = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, scale)))
    if held.where(F.size("x") != len(mean)).limit(1).count():
        raise ValueError("vectors differ in length")
    standard = work.save(held.select(F.zip_with("x", fixed, lambda v, f: (v - f["m"]) / f["s"]).alias("x"), "y"), "standardised")
    state = np.zeros((len(classes), len(mean) + 1))
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, iterations + 1):
        slope = gradient(standard, state[:, :-1], state[:, -1])
        slope[:, :-1] += l2 * state[:, :-1]
        first = BETAS[0] * first + (1 - BETAS[0]) * slope
        second = BETAS[1] * second + (1 - BETAS[1]) * slope**2
        state = state - rate / (1 - BETAS[0] ** step) * first / (np.sqrt(second / (1 - BETAS[1] ** step)) + EPSILON)
        if not np.isfinite(state).all():
            raise ValueError("training is no longer finite")
    work.drop("usable", "standardised")
    return SoftmaxModel(classes, mean, scale, state[:, :-1], state[:, -1])


def temperatures(low: float, high: float, n: int) -> np.ndarray:
    """``n`` temperatures from ``low`` to ``high``, even in their logarithm, and 1 if it lies between."""
    grid = np.logspace(np.log10(low), np.log10(high), n)
    grid[0], grid[-1] = low, high
    return np.unique(np.append(grid, 1.0) if low <= 1 <= high else grid)


def temperature_losses(rows: DataFrame, vector: str, target: str, model: SoftmaxModel, grid: np.ndarray) -> DataFrame:
    """``temperature, n, loss``: mean cross entropy of the calibration rows at each temperature of the grid, in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast((model, grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, heats = shared.value
        total, n = np.zeros(len(heats)), 0
        for batch in batches:
            x, y = _matrix(batch.column(0), len(own.mean)), batch.column(1).to_numpy()
            logits = (x - own.mean) / own.scale @ own.weights.T + own.bias
            for i, heat in enumerate(heats):
                total[i] -= _logs(logits / heat)[np.arange(len(y)), y].sum()
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(heats), pa.array(total), pa.array(np.full(len(heats), n))], names=["temperature", "total", "n"])

    sums = usable(rows, vector, target, model.classes).mapInArrow(run, "temperature double, total double, n bigint")
    return sums.groupBy("temperature").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("loss"))


def calibrated(rows: DataFrame, vector: str, target: str, model: SoftmaxModel, bounds: tuple[float, float] = (0.05, 20.0), n: int = 65) -> SoftmaxModel:
    """``model`` with the temperature of the least loss on rows it wasn't trained on; the lowest on ties. ``ValueError`` without rows."""
    found = temperature_losses(rows, vector, target, model, temperatures(*bounds, n)).collect()
    if not found:
        raise ValueError("calibration needs rows")
    loss, heat = min((r["loss"], r["temperature"]) for r in found)
    return SoftmaxModel(model.classes, model.mean, model.scale, model.weights, model.bias, heat, loss)
