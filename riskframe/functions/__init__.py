"""Column builders."""

from riskframe.functions.binning import cut, quantile_label
from riskframe.functions.dates import period_start
from riskframe.functions.labels import (
    agreement,
    confidence_level,
    correctness,
    risk_category,
    risk_factors,
)

__all__ = [
    "agreement",
    "confidence_level",
    "correctness",
    "cut",
    "period_start",
    "quantile_label",
    "risk_category",
    "risk_factors",
]
