"""Linear models for many targets on the same features, from one pass over the rows."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols, HasRegParam
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gramian(df: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X of the columns and a column of ones, the last one.

    Each task sums up its rows' products in the JVM, and tasks combine in a tree: what reaches the driver is
    one square matrix, whatever the number of rows.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"_{n}") for n, c in enumerate(columns)], F.lit(1.0).alias("_one"))
    assembled = VectorAssembler(inputCols=rows.columns, outputCol="_row").transform(rows).select("_row")
    vectors = MLUtils.convertVectorColumnsFromML(assembled, "_row")
    return RowMatrix(vectors, 0, len(rows.columns)).computeGramianMatrix().toArray()


def solved(gram: np.ndarray, n_features: int, reg_param: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (a row per target) and intercepts of ridge regressions of all targets on all features.

    Features and targets are brought to deviation 1; the penalty is ``reg_param`` over the target's deviation
    there, and leaves the intercept free. A feature that never varies gets 0.
    """
    n, means = gram[-1, -1], gram[-1, :-1] / gram[-1, -1]
    spread = gram[:-1, :-1] / n - np.outer(means, means)
    deviation = np.sqrt(np.maximum(np.diag(spread), 0))
    varies = deviation[:n_features] > 1e-12 * np.maximum(1, np.abs(means[:n_features]))
    x, y = deviation[:n_features][varies], deviation[n_features:]
    among = spread[:n_features, :n_features][np.ix_(varies, varies)] / np.outer(x, x)
    coefficients = np.zeros((len(y), n_features))
    for target, scale in enumerate(y):
        if scale > 0 and varies.any():
            toward = spread[:n_features, n_features + target][varies] / (x * scale)
            weights = np.linalg.lstsq(among + np.eye(len(x)) * (reg_param / scale), toward, rcond=None)[0]
            coefficients[target, varies] = weights * scale / x
    return coefficients, means[n_features:] - coefficients @ means[:n_features]


class LinearTargets(Estimator, HasInputCols, HasOutputCols, HasRegParam, DefaultParamsReadable, DefaultParamsWritable):
    """One ridge regression per target, all from one matrix of sums of products."""

    targetCols = Param(Params._dummy(), "targetCols", "columns to predict", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, targetCols: list[str] | None = None, outputCols: list[str] | None = None, regParam: float = 0.0):
        super().__init__()
        self._setDefault(regParam=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LinearTargetsModel:
        features, targets = self.getInputCols(), self.getOrDefault("targetCols")
        if dataset.isEmpty():
            raise ValueError("no rows to fit")
        gram = gramian(dataset, [*features, *targets])
        coefficients, intercepts = solved(gram, len(features), self.getRegParam())
        return LinearTargetsModel(inputCols=features, outputCols=self.getOutputCols(), coefficients=coefficients.ravel().tolist(), intercepts=intercepts.tolist())


class LinearTargetsModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the prediction of each target as a plain column expression."""

    coefficients = Param(Params._dummy(), "coefficients", "features of the first target, then of the next", TypeConverters.toListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "one per target", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None, coefficients: list[float] | None = None, intercepts: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def matrix(self) -> np.ndarray:
        return np.array(self.getOrDefault("coefficients")).reshape(len(self.getOutputCols()), -1)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, intercepts = self.getInputCols(), self.getOrDefault("intercepts")
        out = {
            output: reduce(add, [F.col(c) * float(w) for c, w in zip(names, row, strict=True)], F.lit(float(start)))
            for output, row, start in zip(self.getOutputCols(), self.matrix(), intercepts, strict=True)
        }
        return dataset.withColumns(out)
