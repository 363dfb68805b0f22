"""Kernel machines: random Fourier features as a pipeline stage, and probabilities from held-out margins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 128
SEED = 42
HELD_OUT = 4  # one row in so many calibrates


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """sqrt(2 / size) cos(w x + b): products of two rows come near the kernel exp(-gamma |x - y|^2).

    The draws follow from the seed and the number of features. ``gamma`` 0 stands for 1 / features, for scaled features.
    """

    size = Param(Params._dummy(), "size", "number of features made", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="fourier", size=SIZE, gamma=0.0, seed=SEED):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="fourier", size=SIZE, gamma=0.0, seed=SEED)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, gamma, seed = (self.getOrDefault(p) for p in (self.size, self.gamma, self.seed))

        def made(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in series:
                if not len(x):
                    yield pd.Series([], dtype=object)
                    continue
                rows = np.stack(x)
                draw = np.random.default_rng([seed, rows.shape[1], size])
                w = draw.standard_normal((rows.shape[1], size)) * np.sqrt(2 * (gamma or 1 / rows.shape[1]))
                b = draw.uniform(0, 2 * np.pi, size)
                yield pd.Series(list(np.sqrt(2 / size) * np.cos(rows @ w + b)), dtype=object)

        column = F.pandas_udf(made, "array<double>")(vector_to_array(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(column))


class PlattModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` = 1 / (1 + exp(-(slope * margin + intercept))) from ``rawPrediction``."""

    slope = Param(Params._dummy(), "slope", "factor of the margin", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "added to it", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
        p = 1 / (1 + F.exp(-(margin * self.getOrDefault(self.slope) + self.getOrDefault(self.intercept))))
        made = dataset.withColumn("probability", array_to_vector(F.array(1 - p, p)))
        return made.withColumn("prediction", (F.get(vector_to_array("probability"), F.lit(1)) > 0.5).cast("double"))


class CalibratedSVC(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol):
    """A linear support vector machine with probabilities from the margins of rows it was not fitted to.

    One row in ``HELD_OUT``, by a hash of its features, is left out of the machine and fits the probabilities.
    """

    regParam = Param(Params._dummy(), "regParam", "regularisation", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "most iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="fourier", labelCol="label", weightCol=None, regParam=0.001, maxIter=100):
        super().__init__()
        self._setDefault(featuresCol="fourier", labelCol="label", regParam=0.001, maxIter=100)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        columns = {"featuresCol": self.getFeaturesCol(), "labelCol": self.getLabelCol()}
        if self.isDefined(self.weightCol):
            columns["weightCol"] = self.getWeightCol()
        part = F.pmod(F.xxhash64(vector_to_array(self.getFeaturesCol())), F.lit(HELD_OUT))
        svc = LinearSVC(**columns, regParam=self.getOrDefault(self.regParam), maxIter=self.getOrDefault(self.maxIter))
        machine = svc.fit(dataset.where(part != 0))
        margins = machine.transform(dataset.where(part == 0)).withColumn(
            "margin", array_to_vector(F.array(F.get(vector_to_array("rawPrediction"), F.lit(1))))
        )
        columns["featuresCol"] = "margin"
        fitted = LogisticRegression(**columns, predictionCol="p", rawPredictionCol="r", probabilityCol="q").fit(margins)
        platt = PlattModel()
        platt._set(slope=float(fitted.coefficients[0]), intercept=float(fitted.intercept))
        return PipelineModel(stages=[machine, platt])
