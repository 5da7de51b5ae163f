"""Fitted preprocessing as an ML model: it is saved, loaded and applied as one expression of constant size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curafold.operators.features import fit_preprocess


class _Columns(Params):
    inputCol = Param(Params._dummy(), "inputCol", "array of the feature values of a row", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "array of the kept and filled values", TypeConverters.toString)


class PreprocessModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fills missing values with the training medians and keeps the features that vary in training.

    ``kept`` has the places of these features and ``medians`` their medians, in the same order. A NULL or
    short array counts as missing values.
    """

    kept = Param(Params._dummy(), "kept", "places of the kept features", TypeConverters.toListInt)
    medians = Param(Params._dummy(), "medians", "training medians of the kept features", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol: str = "values", outputCol: str = "filled", kept: Sequence[int] = (), medians: Sequence[float] = ()):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, kept=list(kept), medians=list(medians))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # Arrays of numpy are one literal each, however many features there are.
        kept = F.lit(np.array(self.getOrDefault("kept"), np.int32))
        medians = F.lit(np.array(self.getOrDefault("medians"), np.float64))
        values = F.col(self.getOrDefault("inputCol"))
        filled = F.zip_with(kept, medians, lambda place, median: F.coalesce(F.get(values, place).cast("double"), median))
        return dataset.withColumn(self.getOrDefault("outputCol"), filled)


class Preprocess(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a :class:`PreprocessModel`; the driver gets one row per feature."""

    @keyword_only
    def __init__(self, inputCol: str = "values", outputCol: str = "filled"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> PreprocessModel:
        long = dataset.select(F.posexplode(self.getOrDefault("inputCol")).alias("feature", "value"))
        fitted = fit_preprocess(long).where("kept").select("feature", "median").orderBy("feature").collect()
        return PreprocessModel(
            inputCol=self.getOrDefault("inputCol"), outputCol=self.getOrDefault("outputCol"),
            kept=[r["feature"] for r in fitted], medians=[r["median"] for r in fitted],
        )


def as_values(df: DataFrame, features: Sequence[str], out: str = "values") -> DataFrame:
    """Feature columns as one array."""
    return df.withColumn(out, F.array(*[F.col(f).cast("double") for f in features]))
