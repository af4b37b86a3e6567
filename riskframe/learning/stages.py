"""Pipeline stages that Spark ML lacks."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SoftVote(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of several probability vectors; class 1 only above one half."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        if inputCols:
            self._set(inputCols=inputCols)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        votes = [vector_to_array(c)[1] for c in self.getInputCols()]
        mean = sum(votes[1:], votes[0]) / len(votes)
        return dataset.withColumns(
            {
                "probability": array_to_vector(F.array(1 - mean, mean)),
                "prediction": (mean > 0.5).cast("double"),
            }
        )
