"""Nyström features of a Gaussian kernel (Williams and Seeger, 2001)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is added to the landmarks' own kernel, relative to its diagonal of 1.
JITTER = 1e-8


def gaussian(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma * |a - b|^2) of the rows of ``x`` and ``y``."""
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(squares, 0))


class NystromModel(
    Transformer, HasFeaturesCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Adds the features: products of two approximate the kernel of standardised rows."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    center = Param(Params._dummy(), "center", "means of the columns", TypeConverters.toListFloat)
    unit = Param(Params._dummy(), "unit", "deviations of the columns", TypeConverters.toListFloat)
    landmarks = Param(
        Params._dummy(), "landmarks", "standardised landmarks, one after another",
        TypeConverters.toListFloat,
    )

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol: str = "features",
        outputCol: str = "kernel_features",
        gamma: float = 1.0,
        center: list[float] | None = None,
        unit: list[float] | None = None,
        landmarks: list[float] | None = None,
    ):
        super().__init__()
        self._setDefault(outputCol="kernel_features", gamma=1.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def mapping(self) -> Callable[[np.ndarray], np.ndarray]:
        """The map from rows of columns to rows of features."""
        gamma = self.getOrDefault(self.gamma)
        center, unit = (np.array(self.getOrDefault(p)) for p in (self.center, self.unit))
        marks = np.array(self.getOrDefault(self.landmarks)).reshape(-1, len(center))
        own = gaussian(marks, marks, gamma) + JITTER * np.eye(len(marks))
        # Products of whitened rows k(x) L^-T are k(x) (L L^T)^-1 k(y).
        whiten = np.linalg.inv(np.linalg.cholesky(own)).T
        return lambda rows: gaussian((rows - center) / unit, marks, gamma) @ whiten

    def _transform(self, dataset: DataFrame) -> DataFrame:
        to_features = self.mapping()

        @F.pandas_udf("array<double>")
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                if len(batch):
                    yield pd.Series(list(to_features(np.stack(batch.to_list()))))
                else:
                    yield pd.Series([], dtype=object)

        source = vector_to_array(F.col(self.getFeaturesCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped(source)))


class Nystrom(
    Estimator, HasFeaturesCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable
):
    """Standardises the columns, draws landmarks and fixes the kernel's width.

    Landmarks are seeded by the distributed form of k-means++ and moved to the
    centres of what is nearest to them, so that they cover the rows however these
    are spread. There are ``size`` of them at most, whatever the number of rows,
    and fewer where there are fewer different rows. ``gamma`` of 0 stands for
    one over the number of columns that vary: with unit deviations this is one over
    columns times variance.

    A column that does not vary takes no part. Equal rows get equal features.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "most landmarks", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol: str = "features",
        outputCol: str = "kernel_features",
        gamma: float = 0.0,
        size: int = 256,
        seed: int = 42,
    ):
        super().__init__()
        self._setDefault(outputCol="kernel_features", gamma=0.0, size=256, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NystromModel:
        features = self.getFeaturesCol()
        scaling = StandardScaler(
            inputCol=features, outputCol="_standardised", withMean=True, withStd=True
        ).fit(dataset)
        varies = scaling.std.toArray() > 0
        unit = np.where(varies, scaling.std.toArray(), np.inf)
        center = scaling.mean.toArray()
        # Spark's scaler maps a constant column to 0, as dividing by infinity does.
        rows = scaling.transform(dataset.select(features)).select("_standardised")
        found = KMeans(
            featuresCol="_standardised",
            k=max(2, self.getOrDefault(self.size)),
            initMode="k-means||",
            maxIter=5,
            seed=self.getSeed(),
        ).fit(rows)
        marks = np.unique(np.stack(found.clusterCenters()), axis=0)
        gamma = self.getOrDefault(self.gamma) or 1.0 / max(1, int(varies.sum()))
        return NystromModel(
            featuresCol=features,
            outputCol=self.getOutputCol(),
            gamma=gamma,
            center=center.tolist(),
            unit=unit.tolist(),
            landmarks=marks.ravel().tolist(),
        )
