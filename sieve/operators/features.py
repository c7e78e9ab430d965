"""Standardise -> PCA(variance ratio) as Spark ML stages, fitted on training rows only.

* ``PopulationStandardScaler``: Spark's StandardScaler divides by the sample sd
  (ddof 1); the reference's scaler uses the population sd (ddof 0).  The fitted
  model is StandardScaler followed by an ElementwiseProduct with sqrt(n/(n-1)):
  two built-in, persistable stages.
* ``PCAByVariance``: fits the full PCA once to read ``explainedVariance``, keeps
  the smallest k whose cumulative ratio exceeds the target, and refits with k.
  Input must be centred (Spark's PCA does not centre on transform), which the
  scaler above guarantees.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
PCA_VARIANCE = 0.95
# ---------------------------------------------------------------------------


def column_moments(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Per dimension: mean, population sd, and the scale used (sd, or 1 if sd = 0)."""
    el = df.select(F.posexplode(vec).alias("dim", "x"))
    m = el.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd_pop"))
    return m.withColumn("scale", F.when(F.col("sd_pop") == 0, F.lit(1.0)).otherwise(F.col("sd_pop"))) \
            .select(F.col("dim").cast("int").alias("dim"), "mean", "sd_pop", "scale")


def k_for_variance(ratios: list[float], target: float = PCA_VARIANCE) -> int:
    """Smallest k whose cumulative explained-variance ratio is strictly above target."""
    acc = 0.0
    for i, r in enumerate(ratios):
        acc += r
        if acc > target:
            return i + 1
    return len(ratios)


def variance_curve(ratios: list[float], spark) -> DataFrame:
    """(pc, ratio, cumulative) with the cumulative sum as a running window."""
    df = spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(ratios)], "pc int, ratio double")
    w = Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, Window.currentRow)   # one row per component
    return df.withColumn("cumulative", F.sum("ratio").over(w))


class PopulationStandardScaler(Estimator, HasInputCol, HasOutputCol):
    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PipelineModel:
        tmp = self.getOutputCol() + "_sample_sd"
        sm = StandardScaler(withMean=True, withStd=True, inputCol=self.getInputCol(), outputCol=tmp).fit(df)
        n = df.count()
        d = len(sm.mean)
        f = math.sqrt(n / (n - 1)) if n > 1 else 1.0
        ep = ElementwiseProduct(scalingVec=Vectors.dense([f] * d), inputCol=tmp, outputCol=self.getOutputCol())
        return _DropTemp(PipelineModel([sm, ep]), tmp)


class _DropTemp(PipelineModel):
    """PipelineModel that drops its intermediate column."""

    def __init__(self, inner: PipelineModel, tmp: str):
        super().__init__(inner.stages)
        self._tmp = tmp

    def _transform(self, df: DataFrame) -> DataFrame:
        return super()._transform(df).drop(self._tmp)


class PCAByVariance(Estimator, HasInputCol, HasOutputCol):
    varianceRatio = Param(Params._dummy(), "varianceRatio", "variance to keep (0, 1]",
                          typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, varianceRatio=PCA_VARIANCE):
        super().__init__()
        self._setDefault(varianceRatio=PCA_VARIANCE)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        first = df.select(self.getInputCol()).first()
        d = first[0].size
        full = PCA(k=d, inputCol=self.getInputCol(), outputCol=self.getOutputCol()).fit(df)
        ratios = list(full.explainedVariance.toArray())
        k = k_for_variance(ratios, self.getOrDefault(self.varianceRatio))
        model = full if k == d else PCA(k=k, inputCol=self.getInputCol(), outputCol=self.getOutputCol()).fit(df)
        model.full_ratios = ratios
        model.n_components_ = k
        return model
