"""Labels derived from a probability or from a pair of outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels and thresholds which results must carry.
RISK_CATEGORIES = ("Low Risk", "Moderate Risk", "High Risk", "Very High Risk")
RISK_THRESHOLDS = (0.2, 0.4, 0.6)
CONFIDENCE_LEVELS = ("Very Low", "Low", "Medium", "High", "Very High")
CONFIDENCE_THRESHOLDS = (0.2, 0.4, 0.6, 0.8)
OLDER_GROUPS = ("50-55", "55-60", "60-65", "65-70", ">70")
RISK_FACTOR_CUTOFF = 0.6


def _ladder(col: Column, thresholds: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed steps. A null value passes every test and gets the last label."""
    if len(labels) != len(thresholds) + 1 or list(thresholds) != sorted(thresholds):
        raise ValueError("need ascending thresholds, one fewer than labels")
    out = F.when(col < thresholds[0], labels[0])
    for limit, label in zip(thresholds[1:], labels[1:]):
        out = out.when(col < limit, label)
    return out.otherwise(labels[-1])


def risk_category(
    probability: Column, thresholds: Sequence[float] = RISK_THRESHOLDS
) -> Column:
    return _ladder(probability, thresholds, RISK_CATEGORIES)


def confidence_level(
    probability: Column, thresholds: Sequence[float] = CONFIDENCE_THRESHOLDS
) -> Column:
    return _ladder(probability, thresholds, CONFIDENCE_LEVELS)


def correctness(prediction: Column, target: Column) -> Column:
    return F.when(prediction == target, "Correct").otherwise("Incorrect")


def agreement(first: Column, second: Column) -> Column:
    return F.when(first == second, "Agreement").otherwise("Disagreement")


def risk_factors(
    age_group: Column,
    exang: Column,
    above_cutoff: Column,
    older_groups: Sequence[str] = OLDER_GROUPS,
) -> Column:
    """First rule that holds. ``above_cutoff`` is the test on the probability."""
    return (
        F.when(above_cutoff & age_group.isin(*older_groups), "High Risk Age Group")
        .when(above_cutoff & (exang == "Yes"), "High Risk with Exercise Angina")
        .otherwise("Standard Risk")
    )
