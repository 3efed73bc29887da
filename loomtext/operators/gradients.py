"""Linear and kernel classifiers by mini-batch gradients.

Rows are dealt into batches by a hash of their key and the seed and written once, a folder for
each batch, so a step reads its own batch only. A step sums the batch's gradients where the
rows are read, a partial sum for each task and component, and Spark adds these up; the
weights, whose size is that of one row, are all that comes back.

The kernel classifier is the linear one on random Fourier features (Rahimi and Recht 2007):
sqrt(2 / D) cos(w x + b) with normal w and uniform b, whose inner products tend to those of
the Gaussian kernel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.stored import new_path


@dataclass(frozen=True)
class Fourier:
    """Random features of the kernel exp(-gamma |x - y|^2)."""

    weights: np.ndarray
    shifts: np.ndarray

    @classmethod
    def draw(cls, width: int, features: int, gamma: float, seed: int) -> Fourier:
        rng = np.random.Generator(np.random.PCG64(seed))
        return cls(rng.normal(0.0, np.sqrt(2 * gamma), (width, features)), rng.uniform(0.0, 2 * np.pi, features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.shifts)) * np.cos(x @ self.weights + self.shifts)


def gradient(loss: str, scores: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The derivative of each row's loss by its score; signs are 1 and -1."""
    if loss == "hinge":
        return np.where(signs * scores < 1, -signs, 0.0)
    if loss == "log":
        return -signs / (1 + np.exp(np.clip(signs * scores, -500, 500)))
    raise ValueError(f"no such loss: {loss}")


def stepped(weights: np.ndarray, total: np.ndarray, rows: int, step: int, rate: float, l2: float) -> np.ndarray:
    """The weights after one step; the last one is the bias, which isn't shrunk."""
    if not rows:
        return weights
    shrunk = np.append(weights[:-1] * l2, 0.0)
    return weights - rate / np.sqrt(1 + step) * (total / rows + shrunk)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    features: Fourier | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x) if self.features else x
        return z @ self.weights[:-1] + self.weights[-1]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def dealt(key: Column, batches: int, seed: int) -> Column:
    """The batch of a row."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(batches)).cast("int")


def fit(rows: DataFrame, width: int, loss: str = "hinge", epochs: int = 5, batches: int = 8, rate: float = 0.5, l2: float = 1e-4, seed: int = 42, features: Fourier | None = None) -> Model:
    """A model from rows (key, vec of ``width`` numbers, label 0 or 1), the batches in their order in each epoch."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession)
    rows.select(dealt(F.col("key"), batches, seed).alias("batch"), F.col("vec").cast("array<double>").alias("vec"), F.col("label").cast("int").alias("label")).write.partitionBy("batch").parquet(path)
    stored = spark.read.schema("vec array<double>, label int, batch int").parquet(path)
    weights = np.zeros((len(features.shifts) if features else width) + 1)
    for step in range(epochs * batches):
        shared = spark.sparkContext.broadcast(Model(weights, features))

        def partial(found: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            total, n = np.zeros(len(model.weights)), 0
            for batch in found:
                x, signs = _matrix(batch.column(0)), 2.0 * batch.column(1).to_numpy(zero_copy_only=False) - 1
                if not len(signs):
                    continue
                z = model.features(x) if model.features else x
                g = gradient(loss, z @ model.weights[:-1] + model.weights[-1], signs)
                total += np.append(g @ z, g.sum())
                n += len(signs)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.append(total, n))], names=["component", "value"])

        sums = stored.where(F.col("batch") == step % batches).select("vec", "label").mapInArrow(partial, "component long, value double").groupBy("component").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(len(weights) + 1)
        for r in sums:
            total[r["component"]] = r["value"]
        shared.unpersist()
        weights = stepped(weights, total[:-1], int(total[-1]), step, rate, l2)
    return Model(weights, features)


def predicted(rows: DataFrame, model: Model) -> DataFrame:
    """rows (with vec) and score and predicted (0 or 1)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(vec):
        import pandas as pd

        return pd.Series(shared.value.scores(np.array(vec.tolist(), np.float64).reshape(len(vec), -1)) if len(vec) else [], dtype=float)

    return rows.withColumn("score", score(F.col("vec").cast("array<double>"))).withColumn("predicted", (F.col("score") > 0).cast("int"))
