"""Feature scaling by population deviation, as a Spark ML stage that saves and loads."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ColumnScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns mean and population deviation of each column in one aggregate.

    A column that never varies keeps scale 1, so it becomes 0. (The stock scaler divides by the
    sample deviation.)
    """

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ColumnScalerModel:
        names = self.getInputCols()
        # One row with two numbers per feature comes to the driver, whatever the size of the data.
        stats = dataset.agg(
            *[F.avg(c).alias(f"_m{n}") for n, c in enumerate(names)],
            *[F.stddev_pop(c).alias(f"_d{n}") for n, c in enumerate(names)],
        ).first()
        means = [float(stats[f"_m{n}"] or 0.0) for n in range(len(names))]
        scales = [float(stats[f"_d{n}"] or 1.0) for n in range(len(names))]
        return ColumnScalerModel(inputCols=names, means=means, scales=scales)


class ColumnScalerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces each column by ``(value - mean) / scale``."""

    means = Param(Params._dummy(), "means", "mean per column", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "scale per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, means: list[float] | None = None,
                 scales: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted = zip(self.getInputCols(), self.getOrDefault("means"), self.getOrDefault("scales"), strict=True)
        return dataset.withColumns({c: (F.col(c) - mean) / scale for c, mean, scale in fitted})
