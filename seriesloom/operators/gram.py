"""Linear and ridge fits of many labels from one aggregate.

The products of all features and the label with one another are summed for every label's
train rows inside tasks and added up by one aggregate; each model is then the solution of a
small linear system. A scan so serves every label and every penalty.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.boosting import Task


class LinearModel(Model, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A weighted sum of columns as a pipeline stage; scoring stays in compiled expressions."""

    inputs = Param(Params._dummy(), "inputs", "columns", TypeConverters.toListString)
    weights = Param(Params._dummy(), "weights", "one for each column", TypeConverters.toListFloat)
    constant = Param(Params._dummy(), "constant", "intercept", TypeConverters.toFloat)

    @staticmethod
    def of(inputs: list[str], weights, constant: float) -> "LinearModel":
        return LinearModel()._set(inputs=list(inputs), weights=[float(w) for w in weights], constant=float(constant))

    @property
    def coefficients(self) -> DenseVector:
        return Vectors.dense(self.getOrDefault(self.weights))

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.constant)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = [F.col(c) * F.lit(w) for c, w in zip(self.getOrDefault(self.inputs), self.getOrDefault(self.weights))]
        total = reduce(lambda a, b: a + b, parts, F.lit(self.intercept))
        return dataset.withColumn(self.getPredictionCol(), total)


def moments(df: DataFrame, inputs: list[str], tasks: list[Task]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Of each task's train rows their number, means, and centred products of inputs and label.

    Columns are shifted by their means over all rows before they are multiplied, so large
    values with little spread lose no digits.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    labels = [F.col(t.label).cast("double") for t in tasks]
    shift = df.agg(*[F.avg(number(c)) for c in inputs], *[F.avg(y) for y in labels]).first()
    shift = np.array([float(v or 0.0) for v in shift])
    m = len(inputs)
    used = [
        F.col(t.label).isNotNull() & (F.lit(True) if t.split is None else F.coalesce(F.col(t.split) == "train", F.lit(False)))
        for t in tasks
    ]
    wide = df.select(
        F.array(*[number(c) for c in inputs]).alias("x"), F.array(*[F.coalesce(y, F.lit(0.0)) for y in labels]).alias("y"),
        F.array(*[u.cast("double") for u in used]).alias("u"),
    )

    def run(batches):
        sums = np.zeros((len(tasks), (m + 2) ** 2))
        for batch in batches:
            flat = lambda name, k: batch.column(name).flatten().to_numpy().reshape(-1, k)
            x, y, u = flat("x", m) - shift[:m], flat("y", len(tasks)) - shift[m:], flat("u", len(tasks)) > 0
            for t in range(len(tasks)):
                rows = np.column_stack([np.ones(u[:, t].sum()), x[u[:, t]], y[u[:, t], t]])
                sums[t] += (rows.T @ rows).ravel()
        yield pa.RecordBatch.from_arrays([
            pa.array(range(len(tasks)), pa.int32()),
            pa.ListArray.from_arrays(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32), sums.ravel()),
        ], names=["task", "v"])

    made = wide.mapInArrow(run, "task int, v array<double>")
    total = made.groupBy("task").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("v")))).alias("v"))
    found = {r["task"]: np.array(r["v"]).reshape(m + 2, m + 2) for r in total.collect()}
    out = []
    for t in range(len(tasks)):
        s = found.get(t, np.zeros((m + 2, m + 2)))
        n = s[0, 0]
        mean = s[0, 1:] / max(n, 1.0)
        out.append((float(n), mean + np.append(shift[:m], shift[m + t]), s[1:, 1:] - n * np.outer(mean, mean)))
    return out


def solve(n: float, means: np.ndarray, products: np.ndarray, inputs: list[str], penalty: float = 0.0) -> LinearModel:
    """Weights of least squares with a penalty on raw features; the constant is not penalised.

    Columns that the others determine get the least weights, as a pseudo-inverse gives.
    """
    if not n:
        raise ValueError("no labelled train rows")
    a, b = products[:-1, :-1], products[:-1, -1]
    scale = np.sqrt(np.diag(a))
    scale[scale == 0] = 1.0
    scaled = (a + penalty * np.eye(len(a))) / np.outer(scale, scale)
    weights = np.linalg.lstsq(scaled, b / scale, rcond=1e-12)[0] / scale if len(a) else b
    return LinearModel.of(inputs, weights, means[-1] - means[:-1] @ weights)


def fit_linear_many(df: DataFrame, inputs: list[str], tasks: list[Task], penalties: list[float]) -> list[list[LinearModel]]:
    """For each task a model of every penalty, from one aggregate over ``df``."""
    return [
        [solve(n, means, products, inputs, penalty) for penalty in penalties]
        for n, means, products in moments(df, inputs, tasks)
    ]
